"""Long spans that occur verbatim in more than one record, by suffix automata of reference shards.

Every span of ``length`` characters that two records share contains an anchor: winnowing takes, of each
``length - GRAM + 1`` neighbouring windows of ``GRAM`` characters, the one whose hash is smallest, which depends on
nothing but those characters.  So records can only share where an anchor occurs in several of them.  The
text around such an anchor, as far as a span through it can matter, goes to the shard of the anchor;
equal surroundings are merged first and keep count of their records, so a passage that fills
a third of the table is one row of its shard per anchor.  Each shard builds one generalised suffix automaton
over its surroundings, whose states know whether several records own them, and streams them through it:
the matching statistics of what others own give the maximal shared spans.  An anchor with more different
surroundings than one automaton should hold (a phrase shorter than ``length`` in very many records) is
settled exactly by the hashes of all windows through it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, cut, partitions
from .automata import SuffixAutomaton
from .wordsets import mix

GRAM = 100
#: Characters of surroundings that one automaton holds, about, and that one task gets, about; they bound a task's memory.
SHARD_CHARS, TASK_CHARS = 60_000, 2_000_000
#: Different surroundings of one anchor beyond which its windows are compared by hash, in Spark, instead.
HOT_BODIES = 1_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of ``width`` code points, by doubling."""
    h = mix(codes.astype(np.uint64) + np.uint64(1))
    have, parts, need, at = 1, None, width, 0
    while True:
        if need & have:
            piece = h[at:] if parts is None else None
            if parts is None:
                parts, at = h, have
            else:
                n = min(len(parts), len(h) - at)
                parts = mix(parts[:n] * _BASE + h[at : at + n])
                at += have
        if have * 2 > need:
            break
        n = len(h) - have
        if n <= 0:
            return np.empty(0, np.uint64)
        h = mix(h[:n] * _BASE + h[have : have + n] * np.uint64(3))
        have *= 2
    n = len(codes) - width + 1
    return parts[:n] if n > 0 else np.empty(0, np.uint64)


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    rest = width - have
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def anchors(texts: list[str], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position and hash of the anchors of ``texts``, each of ``length`` characters at least."""
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    h = window_hashes(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), GRAM) | np.uint64(1)
    w = length - GRAM + 1
    low = sliding_min(h, w)
    at = np.arange(len(low))
    low[ends[np.searchsorted(ends, at, side="right")] - at < length] = 0  # windows that reach into the next text
    # a hash is an anchor if it is the least of some window around it
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(h == ~sliding_min(~padded, w))
    doc = np.searchsorted(ends, at, side="right")
    return doc, at - (ends - sizes)[doc], h[at]


def _steps(rows: Iterator[tuple], size: int = 300_000) -> Iterator[list[tuple]]:
    """Rows, whose last element is a text, in lists of about ``size`` characters."""
    out, held = [], 0
    for r in rows:
        out.append(r)
        held += len(r[-1])
        if held >= size:
            yield out
            out, held = [], 0
    if out:
        yield out


def _anchor_rows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = ((tab, rec, text) for tab, rec, text in zip(b[0].to_pylist(), b[1].to_pylist(), b[2].to_pylist()) if text and rec is not None and len(text) >= length)
            for step in _steps(rows):
                doc, _, h = anchors([x[2] for x in step], length)
                tab, rec = np.array([x[0] for x in step], np.uint64)[doc], np.array([_number(x[0], x[1]) for x in step], np.int64)[doc]
                yield pa.RecordBatch.from_arrays([pa.array(mix(h ^ (tab << np.uint64(56))).view(np.int64)), pa.array(rec)], names=["anchor", "rec"])

    return run


def _number(tab: int, rec: str) -> int:
    v = xxhash.xxh3_64_intdigest(f"{tab}\x01{rec}")
    return v - (1 << 64) if v >= 1 << 63 else v


def _surroundings(length: int):
    """(rec_table, rec_id, text, shared anchors) to (anchor, body, rec, rec_table, rec_id, start, lead)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = length - GRAM
        for b in batches:
            out: list[tuple] = []
            for step in _steps(zip(b[0].to_pylist(), b[1].to_pylist(), b[3].to_pylist(), b[2].to_pylist())):
                doc, at, h = anchors([x[3] for x in step], length)
                h = mix(h ^ (np.array([x[0] for x in step], np.uint64)[doc] << np.uint64(56))).view(np.int64)
                keep = np.isin(h, np.concatenate([np.array(x[2], np.int64) for x in step]))
                for d, p, a in zip(doc[keep].tolist(), at[keep].tolist(), h[keep].tolist()):
                    tab, rec, _, text = step[d]
                    start = max(0, p - reach)
                    out.append((a, text[start : p + length], _number(tab, rec), tab, rec, start))
            cols = list(zip(*out)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types)], names=["anchor", "body", "rec", "rec_table", "rec_id", "start"])

    return run


def shared_in(bodies: list[str], owners: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each body its maximal spans of at least ``length`` that another owner's body holds too.

    An owner of -2 stands for several owners.
    """
    sam = SuffixAutomaton()
    for body, owner in zip(bodies, owners):
        sam.add(body, owner)
    sam.settle()
    nxt, shared, size = sam.next, sam.shared, sam.length
    out = []
    for body in bodies:
        v, spans = 0, []
        for i, c in enumerate(body):
            v = nxt[v][c]  # the body is in the automaton
            n = size[shared[v]]
            if n >= length:
                lo = i + 1 - n
                if spans and spans[-1][1] >= lo:
                    spans[-1] = (min(spans[-1][0], lo), i + 1)
                else:
                    spans.append((lo, i + 1))
        out.append(spans)
    return out


def _shards(length: int):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []

        def settle(part: pd.DataFrame) -> None:
            found = shared_in(part["body"].tolist(), part["owner"].tolist(), length)
            for a, body, spans in zip(part["anchor"], part["print"], found):
                rows.extend((a, body, i, j) for i, j in spans)

        # an automaton for each run of whole anchors of about SHARD_CHARS characters
        df = df.sort_values("anchor", kind="stable")
        size = df["body"].str.len().groupby(df["anchor"].to_numpy()).transform("sum").to_numpy() if len(df) else []
        first = np.flatnonzero(np.diff(df["anchor"].to_numpy(), prepend=np.nan) != 0) if len(df) else []
        ends = [*first[1:], len(df)]
        at, held = 0, 0
        for i, j in zip(first, ends):
            held += size[i]
            if held >= SHARD_CHARS:
                settle(df.iloc[at:j])
                at, held = j, 0
        if at < len(df):
            settle(df.iloc[at:])
        cols = list(zip(*rows)) or [(), (), (), ()]
        return pd.DataFrame({"anchor": np.array(cols[0], np.int64), "print": np.array(cols[1], np.int64), "lo": np.array(cols[2], np.int32), "hi": np.array(cols[3], np.int32)})

    return run


def shared_spans(records: DataFrame, length: int = 200) -> tuple[DataFrame, DataFrame]:
    """Spans of at least ``length`` characters that occur in another record of the same rec_table.

    ``records``: rec_table INT, rec_id STRING, text STRING.  Returns (spans: rec_table, rec_id, start, end; each span is
    a maximal shared one or, near others, part of one) and (records: rec_table, rec_id, chars, shared_chars,
    share), the second with a row for each record that shares something.

    A record's repeated rows count once and never match each other; null ids, null texts and texts
    shorter than ``length`` share nothing; extra columns are ignored; an empty table gives empty results.
    ``length`` must be above GRAM.
    """
    if length <= GRAM:
        raise ValueError(f"length must be above {GRAM}")
    records = records.select(F.col("rec_table").cast("int").alias("rec_table"), F.col("rec_id").cast("string").alias("rec_id"), F.col("text").cast("string").alias("text"))
    found = cut(records.mapInArrow(_anchor_rows(length), "anchor long, rec long"), "found")
    per = found.groupBy("anchor").agg(F.min("rec").alias("a"), F.max("rec").alias("b")).where("a <> b").select("anchor")
    shared = cut(found.join(per, "anchor", "left_semi").distinct(), "anchors")
    wanted = cut(shared.groupBy("rec").agg(F.collect_list("anchor").alias("wanted")), "wanted")
    return _spans(records, wanted, length)


def _spans(records: DataFrame, wanted: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [None if r is None or t is None else _number(tab, r) for tab, r, t in zip(b[0].to_pylist(), b[1].to_pylist(), b[2].to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=["rec_table", "rec_id", "text", "rec"])

    spark = records.sparkSession
    long = records.where(F.length("text") >= length).mapInArrow(numbered, "rec_table int, rec_id string, text string, rec long")
    texts = long.join(broadcast_if_small(wanted), "rec").select("rec_table", "rec_id", "text", "wanted")
    around = texts.mapInArrow(_surroundings(length), "anchor long, body string, rec long, rec_table int, rec_id string, start int")
    around = cut(around.withColumn("print", F.xxhash64("body")), "around")
    bodies = around.groupBy("rec_table", "anchor", "print").agg(F.first("body").alias("body"), F.min("rec").alias("lo"), F.max("rec").alias("hi"))
    bodies = cut(bodies, "bodies")
    hot = bodies.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > HOT_BODIES).select("anchor")
    hot = broadcast_if_small(cut(hot, "hot"))
    owner = F.when(F.col("lo") == F.col("hi"), F.pmod(F.col("lo"), F.lit(1 << 62))).otherwise(F.lit(-2))
    chars = bodies.agg(F.sum(F.length("body"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("anchor"), F.lit(max(4 * partitions(spark), chars // TASK_CHARS))).cast("int")
    sharded = bodies.join(hot, "anchor", "left_anti").select("rec_table", "anchor", "print", "body", owner.alias("owner"), shard.alias("shard"))
    hits = sharded.groupBy("rec_table", "shard").applyInPandas(_shards(length), "anchor long, print long, lo int, hi int")
    # anchors in too many different surroundings for one automaton: each window of ``length`` by its hash
    windows = bodies.join(hot, "anchor", "left_semi").where(F.length("body") >= length).withColumn("at", F.explode(F.sequence(F.lit(0), F.greatest(F.length("body") - length, F.lit(0)))))
    windows = windows.withColumn("window", F.xxhash64("anchor", F.substring("body", F.col("at") + 1, F.lit(length))))
    several = windows.groupBy("window").agg(F.min("lo").alias("x"), F.max("hi").alias("y")).where("x <> y").select("window")
    hits = hits.union(windows.join(several, "window").select("anchor", "print", "at", (F.col("at") + length).alias("hi")))
    spans = cut(around.drop("body").join(hits, ["anchor", "print"]).select("rec_table", "rec_id", (F.col("start") + F.col("lo")).alias("start"), (F.col("start") + F.col("hi")).alias("end")).distinct(), "spans")
    # union of a record's spans by gaps and islands
    from pyspark.sql import Window

    w = Window.partitionBy("rec_table", "rec_id").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = spans.withColumn("new", F.greatest(F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0))), F.lit(0)))
    chars = long.groupBy("rec_table", "rec_id").agg(F.max(F.length("text")).alias("chars"))
    totals = own.groupBy("rec_table", "rec_id").agg(F.sum("new").alias("shared_chars")).join(chars, ["rec_table", "rec_id"])
    return spans, totals.select("rec_table", "rec_id", "chars", "shared_chars", (F.col("shared_chars") / F.col("chars")).alias("share"))


def without_spans(records: DataFrame, spans: DataFrame) -> DataFrame:
    """rec_table, rec_id, text of every record (rec_table, rec_id, text) without its ``spans`` (the first result of ``shared_spans``).

    A record is a distinct rec_table and non-null rec_id, with its largest text; what stays around a removed span is
    joined as it stands.  Texts without spans come out whole, null ones as null.
    """
    texts = records.where("rec_id is not null").groupBy("rec_table", "rec_id").agg(F.max("text").alias("text"))
    per = spans.groupBy("rec_table", "rec_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))  # of one text
    kept = F.expr("""concat(
        aggregate(spans, named_struct('out', '', 'at', 0), (acc, x) -> named_struct('out', if(x.start > acc.at, concat(acc.out, substring(text, acc.at + 1, x.start - acc.at)), acc.out), 'at', greatest(acc.at, x.end)), acc -> acc.out),
        substring(text, array_max(transform(spans, x -> x.end)) + 1))""")
    return texts.join(per, ["rec_table", "rec_id"], "left").select("rec_table", "rec_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(kept).alias("text"))


def record_shares(records: DataFrame, totals: DataFrame) -> DataFrame:
    """``totals`` (the second result of ``shared_spans``) with a row for every record, shared or not.

    A record is a distinct rec_table and non-null rec_id.  Where nothing is shared, shared_chars and share are 0;
    null and empty texts have 0 chars.
    """
    every = records.where("rec_id is not null").groupBy("rec_table", "rec_id").agg(F.coalesce(F.max(F.length("text")), F.lit(0)).alias("chars"))
    found = totals.select("rec_table", "rec_id", "shared_chars", "share")
    return every.join(found, ["rec_table", "rec_id"], "left").select(
        "rec_table", "rec_id", "chars", F.coalesce("shared_chars", F.lit(0).cast("long")).alias("shared_chars"), F.coalesce("share", F.lit(0.0)).alias("share")
    )
