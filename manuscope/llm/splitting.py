"""Splitting oversized texts at natural boundaries with a fixed overlap, by dynamic programming."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[^ \t\n\r\f]+")
#: Penalties of a cut by what stands between its two tokens.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD = 0.0, 0.25, 0.4, 1.0, 2.0
#: Words whose full stop ends no sentence.
ABBREVIATIONS = frozenset("approx. bzw. ca. cf. ch. dr. ed. eds. e.g. etc. fig. i.e. max. min. mr. mrs. ms. no. nr. nos. p. pp. p.ej. pág. prof. s. sec. sr. sra. st. tab. u.a. usw. vgl. vol. vs. z.b. art. env.".split())
#: Weight of a piece's squared deviation from the even size, as a share of the limit.
BALANCE = 1.5


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token starts and ends in ``text``, and the penalty of a cut after each token."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    if not spans:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    starts, ends = np.array(spans).T
    pen = np.full(len(spans), WORD)
    for i in range(len(spans) - 1):
        gap, last = text[ends[i] : starts[i + 1]], text[ends[i] - 1]
        lines = gap.count("\n") or gap.count("\r") + 2 * gap.count("\f")
        if lines >= 2:
            pen[i] = PARAGRAPH
        elif lines:
            pen[i] = LINE if last in ".!?:;…|" else min(CLAUSE, LINE + SENTENCE)
        elif last == "." and (text[starts[i] : ends[i]].lower().lstrip("(") in ABBREVIATIONS or text[starts[i + 1]].islower()):
            continue
        elif last in ".!?…" or last in ")\"”»'" and ends[i] - 2 >= starts[i] and text[ends[i] - 2] in ".!?…":
            pen[i] = SENTENCE
        elif last in ",;:–—":
            pen[i] = CLAUSE
    return starts, ends, pen


def cut_points(pen: np.ndarray, limit: int, overlap: int) -> list[int]:
    """Ends of the pieces of ``len(pen)`` tokens; a piece starts ``overlap`` tokens before the last one's end."""
    n, step = len(pen), limit - overlap
    if n <= limit:
        return [n] if n else []
    pieces = -(-(n - overlap) // step)
    even = (n - overlap) / pieces + overlap
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    sizes = np.arange(n + 1)
    off = BALANCE * ((sizes - even) / limit) ** 2
    cost = np.append(0.0, pen)
    cost[n] = 0.0
    # an end before ``overlap`` would start the next piece before the text
    for e in range(overlap + 1, n + 1):
        lo = max(overlap + 1, e - step)
        if e <= limit:
            best[e], back[e] = off[e], 0
        if lo < e:
            c = best[lo:e] + off[e - np.arange(lo, e) + overlap]
            k = int(np.argmin(c))
            if c[k] < best[e]:
                best[e], back[e] = c[k], lo + k
        best[e] += cost[e]
    out, e = [], n
    while e:
        out.append(e)
        e = int(back[e])
    return out[::-1]


def split_oversized(texts: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Pieces of the texts (id STRING, text STRING) with more than ``limit`` tokens.

    Columns: id, piece_no (from 0), start_token, end_token (exclusive), n_tokens, text.  A token is a
    maximal run of characters other than space, tab, line feed, carriage return and form feed.  Each
    piece has at most ``limit`` tokens, is cut out of the text as it stands, and shares exactly
    ``overlap`` tokens with the one before; together the pieces hold every token.  The cuts minimise
    their penalties plus the imbalance of sizes; the earliest of equal solutions is taken.

    Texts within the limit, null and blank ones give no rows; repeated rows of an id (null ones among themselves) count
    once, and of different long texts under one id the largest in string order; extra columns
    are ignored; an empty table gives an empty result.  ``overlap`` must be below ``limit``.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")

    def oversized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # bytes split at the same blanks, but for the vertical tab
            n = [len(_TOKEN.findall(t)) if "\v" in t else len(t.encode("utf-8", "surrogatepass").split()) for t in b[1].to_pylist()]
            yield b.take(pa.array([i for i, x in enumerate(n) if x > limit], pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for key, text in zip(b[0].to_pylist(), b[1].to_pylist()):
                starts, ends, pen = boundaries(text)
                at = 0
                for i, e in enumerate(cut_points(pen, limit, overlap)):
                    out.append((key, i, at, e, e - at, text[starts[at] : ends[e - 1]]))
                    at = e - overlap
            cols = list(zip(*out)) or [()] * 6
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["id", "piece_no", "start_token", "end_token", "n_tokens", "text"])

    # more than ``limit`` tokens need as many characters and the gaps between them
    long = texts.select(F.col("id").cast("string"), F.col("text").cast("string")).where(F.length("text") > 2 * limit)
    one = long.mapInArrow(oversized, "id string, text string").groupBy("id").agg(F.max("text").alias("text"))
    return one.mapInArrow(run, "id string, piece_no int, start_token int, end_token int, n_tokens int, text string")
