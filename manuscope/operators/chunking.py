"""Fixed-window and semantic chunks, token offsets and pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def baseline(docs: DataFrame, chunk: int = 1000, overlap: int = 150) -> DataFrame:
    """doc, chunk_no, id, method, start_token, end_token, n_tokens, text: windows of ``chunk`` tokens that overlap.

    ``docs``: doc, text.  A text without tokens has no chunks; ``overlap`` must be below ``chunk``.
    """
    if not 0 <= overlap < chunk:
        raise ValueError("overlap must be below chunk")
    d = docs.withColumn("tok", T.lossless_tokens(F.col("text"))).withColumn("n", F.size("tok")).where("n > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - overlap - 1, F.lit(0)), F.lit(chunk - overlap))
    d = d.select("doc", "tok", "n", F.posexplode(starts).alias("chunk_no", "start_token")).withColumn("end_token", F.least(F.col("start_token") + chunk, F.col("n")))
    size = F.col("end_token") - F.col("start_token")
    return d.select("doc", "chunk_no", F.format_string("baseline_%d", "chunk_no").alias("id"), F.lit("baseline").alias("method"), "start_token", "end_token", size.alias("n_tokens"), F.array_join(F.slice("tok", F.col("start_token") + 1, size), "").alias("text"))


def _hashed(words: list[str], dim: int) -> np.ndarray:
    import zlib

    v = np.zeros(dim)
    for w in words:
        v[zlib.crc32(w.encode()) % dim] += 1
    n = np.linalg.norm(v)
    return v / n if n else v


def semantic(docs: DataFrame, chunk: int = 1000, overlap: int = 150, threshold: float = 0.55, least: int = 400, dim: int = 256) -> DataFrame:
    """doc, chunk_no, id, method, start_token, end_token, n_tokens, text: sentences packed up to ``chunk`` tokens.

    A chunk ends before a sentence unlike the one before (cosine of hashed words below ``threshold``) once it
    has ``least`` tokens, or when full; the next starts with the last ``overlap`` tokens.  The sizes must be
    0 < overlap < least < chunk, or packing would not advance.  As in the rule followed here, what a sentence has beyond
    the room of its chunk is left out, so sentences longer than ``chunk`` lose their ends.  Each text is packed by itself; texts are never
    grouped.  Offsets are approximate: a chunk starts at the last one's end less the overlap.
    """
    if not 0 < overlap < least < chunk:
        raise ValueError("need 0 < overlap < least < chunk")

    def pack(sents: list[str]) -> list[str]:
        out: list[list[str]] = []
        cur: list[str] = []
        last = None
        for s in sents:
            tok, vec = s.split(), None
            vec = _hashed([w.lower() for w in tok], dim)
            if cur and ((len(cur) + len(tok) > chunk and len(cur) >= least) or (last is not None and len(cur) >= least and float(last @ vec) < threshold)):
                out.append(cur)
                cur = cur[-overlap:]
            cur = (cur + tok)[:chunk]
            last = vec
        if cur:
            out.append(cur)
        return [" ".join(c) for c in out]

    def run(batches):
        for df in batches:
            rows = []
            for doc, text, sents in zip(df["doc"], df["text"], df["sents"]):
                whole = text.split()
                parts = [text] if len(whole) <= chunk else pack(list(sents))
                end = 0
                for i, p in enumerate(parts):
                    n = len(p.split())
                    start = max(0, end - overlap) if i else 0
                    end = start + n
                    rows.append((doc, i, f"semantic_{i}", "semantic", start, end, n, p))
            yield pd.DataFrame(rows, columns=["doc", "chunk_no", "id", "method", "start_token", "end_token", "n_tokens", "text"])

    d = docs.select(F.col("doc").cast("string").alias("doc"), "text", T.sentences(F.col("text")).alias("sents")).where("text is not null and text rlike '[^ \\t\\n\\r\\f]'")
    return d.mapInPandas(run, "doc string, chunk_no int, id string, method string, start_token int, end_token int, n_tokens int, text string")


def token_to_page(pages: DataFrame, starts: DataFrame) -> DataFrame:
    """doc, start, page: the first page whose tokens reach past ``start``; -1 where there is none.

    ``pages``: doc, page, tokens; ``starts``: doc, start.
    """
    w = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    upto = pages.select("doc", "page", F.sum("tokens").over(w).alias("upto"))
    s, p = starts.alias("s"), upto.alias("p")
    found = s.join(p, (F.col("s.doc") == F.col("p.doc")) & (F.col("s.start") < F.col("p.upto")), "left")
    return found.groupBy("s.doc", "s.start").agg(F.coalesce(F.min("p.page"), F.lit(-1)).alias("page"))


def page_by_marker(chunks: DataFrame, marker: str = T.BREAK) -> DataFrame:
    """doc, chunk_no, page, tokens, text: page is 1 plus the markers in earlier chunks; markers go from the text."""
    w = Window.partitionBy("doc").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    n = (F.length("text") - F.length(F.replace("text", F.lit(marker), F.lit("")))) / len(marker)
    bare = F.replace("text", F.lit(marker), F.lit(""))
    return chunks.select(
        "doc", "chunk_no", (1 + F.coalesce(F.sum(n).over(w), F.lit(0))).cast("long").alias("page"), F.size(F.regexp_extract_all(bare, F.lit(r"[^ \t\n\r\f]+"), F.lit(0))).cast("long").alias("tokens"), T.norm_export(bare).alias("text")
    )


def id_map(ids: DataFrame, order: str = "id", prefix: str = "T") -> DataFrame:
    """id, node_id: ids numbered in order, as T_00001.

    The numbers come from counts of range partitions and positions within them, so no task sees all ids.
    """
    ranged = ids.select("id").distinct().repartitionByRange(order)
    inside = ranged.withColumn("part", F.spark_partition_id())
    counts = inside.groupBy("part").agg(F.count("*").alias("n"))
    # one row a partition
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return inside.withColumn("at", at).join(F.broadcast(before), "part").select("id", F.format_string(f"{prefix}_%05d", F.col("before") + F.col("at")).alias("node_id"))
