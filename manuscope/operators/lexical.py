"""TF-IDF weights, search and nearest-neighbour edges; keyword coverage; best sentences."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import BROADCAST_BYTES, cut, stored_bytes
from . import blocks


def grams(words: Column, n: int = 2) -> Column:
    """The words, and with ``n`` of 2 also the pairs of neighbours."""
    if n == 1:
        return words
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def term_counts(docs: DataFrame, n: int = 2, stop: list[str] | None = None) -> DataFrame:
    """id, term, tf of ``docs`` (id, text)."""
    words = T.terms(F.col("text"))
    if stop:
        words = F.filter(words, lambda w: ~w.isin(stop))
    return docs.select("id", F.explode(grams(words, n)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, size: int) -> DataFrame:
    """term, tf, df of the ``size`` most frequent terms, ties by term."""
    per = counts.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))
    return per.orderBy(F.desc("tf"), "term").limit(size)


class Vocabulary(NamedTuple):
    """Words and word pairs with their idf, most frequent first; a bounded number."""

    terms: list[str]
    idf: np.ndarray


def _words(docs: DataFrame, stop: list[str] | None) -> DataFrame:
    """id, words of each text."""
    words = T.terms(F.col("text"))
    if stop:
        words = F.filter(words, lambda w: ~w.isin(stop))
    return docs.select("id", words.alias("words")).where("words is not null")


def _grams(words: pa.Array, number: dict[str, int], n: int, grow: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text, term, count of the words and (with ``n`` of 2) pairs of each list.

    A word is its number, a pair the first one's plus 1 times 2^31 plus the second one's.  Words without a number go, unless ``grow``.
    """
    coded, who = words.flatten().dictionary_encode(), np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
    to = np.array([-1 if not w else number.setdefault(w, len(number)) if grow else number.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
    x = to[coded.indices.to_numpy(zero_copy_only=False)] if len(who) else np.empty(0, np.int64)
    at, term = [who[x >= 0]], [x[x >= 0]]
    if n > 1 and len(x):
        ok = (who[1:] == who[:-1]) & (x[1:] >= 0) & (x[:-1] >= 0)
        at.append(who[1:][ok]), term.append((x[:-1][ok] + 1 << 31) + x[1:][ok])
    at, term = np.concatenate(at), np.concatenate(term)
    kinds, code = np.unique(term, return_inverse=True)
    both, count = np.unique(at * max(1, len(kinds)) + code, return_counts=True)
    at, code = np.divmod(both, max(1, len(kinds)))
    return at, kinds[code], count


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, as the arrays of their words and pairs are many times as large."""
    for b in batches:
        for i in range(0, len(b), _STEP):
            yield b.slice(i, _STEP)


_STEP = 1_000


def _count(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            term, tf = (np.concatenate(x) for x in zip(*held))
            kinds, code = np.unique(term, return_inverse=True)
            return kinds, np.bincount(code, tf, minlength=len(kinds)).astype(np.int64)

        def rows(kinds: np.ndarray, tf: np.ndarray) -> Iterator[pa.RecordBatch]:
            word = list(number)
            for i in range(0, len(kinds), 100_000):
                names = [word[t] if t < 1 << 31 else f"{word[(t >> 31) - 1]} {word[t & (1 << 31) - 1]}" for t in kinds[i : i + 100_000].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(tf[i : i + 100_000])], names=["term", "tf"])

        for b in _slices(batches):
            _, term, count = _grams(b[0], number, n, True)
            kinds, code = np.unique(term, return_inverse=True)
            held.append((kinds, np.bincount(code, count, minlength=len(kinds))))
            if sum(len(x[0]) for x in held) > 1_500_000:
                held = [merged()]
                if len(held[0][0]) > 750_000:
                    yield from rows(*held[0])
                    held = []
                    number.clear()
        if held:
            yield from rows(*merged())

    return run


def _pack(sent, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = sent.value
        number: dict[str, int] = {}
        for t in terms:
            for w in t.split(" "):
                number.setdefault(w, len(number))
        keys = np.array([number[t] if " " not in t else (number[t.split(" ")[0]] + 1 << 31) + number[t.split(" ")[1]] for t in terms], np.int64)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        for b in _slices(batches):
            at, term, count = _grams(b[1], number, n, False)
            if not len(keys):
                continue
            i = np.minimum(np.searchsorted(keys, term), len(keys) - 1)
            known = keys[i] == term
            at, code, count = at[known], order[i[known]], count[known]
            o = np.lexsort((code, at))
            some, many = np.unique(at, return_counts=True)
            start = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b[0].take(pa.array(some)), pa.ListArray.from_arrays(start, pa.array(code[o].astype(np.int32))), pa.ListArray.from_arrays(start, pa.array(count[o].astype(np.int32)))], names=["id", "terms", "ws"]
            )

    return run


def _packed(words: DataFrame, terms: list[str], n: int) -> DataFrame:
    """id, the places of its terms in the vocabulary, and their counts; texts without any are left out.

    The texts of an id that comes several times are one: their counts are added, and no pair of words spans two of them.
    Only what is packed moves for that, never words.
    """
    kind = words.schema["id"].dataType.simpleString()
    schema = f"id {kind}, terms array<int>, ws array<int>"
    sent = words.sparkSession.sparkContext.broadcast(terms)
    packed = cut(words.select("id", "words").mapInArrow(_pack(sent, n), schema), "rows")
    again = cut(packed.groupBy(F.col("id").alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again"), "again")
    if not again.take(1):
        return packed
    on, once, several = F.col("id").eqNullSafe(F.col("again")), None, packed
    if stored_bytes(again) <= BROADCAST_BYTES:
        once, several = (packed.join(F.broadcast(again), on, how) for how in ("left_anti", "left_semi"))
    lists = several.mapInArrow(_add, schema).groupBy("id").agg(F.collect_list(F.struct("terms", "ws")).alias("x"))
    several = lists.select("id", F.flatten("x.terms").alias("terms"), F.flatten("x.ws").alias("ws")).mapInArrow(_add, schema)
    return cut(several if once is None else once.union(several), "rows")


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the counts of equal ids in a batch, and of equal terms; so a frequent id is a row a batch before it moves."""
    for b in batches:
        ids = b[0].dictionary_encode("encode")
        at = np.repeat(ids.indices.to_numpy(zero_copy_only=False).astype(np.int64), b[1].value_lengths().to_numpy(zero_copy_only=False))
        code, count = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (b[1], b[2]))
        size = int(code.max(initial=0)) + 1
        both, i = np.unique(at * size + code, return_inverse=True)
        at, code = np.divmod(both, size)
        some, many = np.unique(at, return_counts=True)
        start = pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32))
        lists = (pa.ListArray.from_arrays(start, pa.array(x.astype(np.int32))) for x in (code, np.bincount(i, count, minlength=len(both))))
        yield pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array(some)), *lists], names=["id", "terms", "ws"])


def _holding(size: int):
    """Terms (their places) and how many rows have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for b in batches:
            df += np.bincount(b[0].flatten().to_numpy(zero_copy_only=False), minlength=size)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], names=["code", "df"])

    return run


def tfidf(docs: DataFrame, size: int = 2000, n: int = 2, stop: list[str] | None = None) -> tuple[DataFrame, Vocabulary]:
    """(rows: id, terms (their places in the vocabulary), ws (their counts); the vocabulary with its smoothed idf).

    Terms are counted where the texts are, so no row a text and term is shuffled or stored, and no text.
    """
    words = _words(docs, stop)
    total = docs.count()
    per = words.select("words").mapInArrow(_count(n), "term string, tf long").groupBy("term").agg(F.sum("tf").alias("tf"))
    terms = [r["term"] for r in per.orderBy(F.desc("tf"), "term").limit(size).collect()]  # ``size`` rows at most
    rows = _packed(words, terms, n)
    df = np.zeros(len(terms))
    for r in rows.select("terms").mapInArrow(_holding(len(terms)), "code int, df long").groupBy("code").agg(F.sum("df").alias("df")).collect():  # as many
        df[r["code"]] = r["df"]
    return rows, Vocabulary(terms, np.log((1 + total) / (1 + df)) + 1)


def search(rows: DataFrame, vocab: Vocabulary, queries: DataFrame, k: int, n: int = 2, stop: list[str] | None = None) -> DataFrame:
    """qid, id, score, rank: cosine of TF-IDF rows, positive scores only, ties by id."""
    q = _packed(_words(queries.select(F.col("qid").alias("id"), "text"), stop), vocab.terms, n).withColumnRenamed("id", "qid")
    return blocks.sparse_topk(rows, q, k, 6, 1e-6, idf=vocab.idf)


def knn_edges(docs: DataFrame, queries: DataFrame | None = None, k: int = 5, least: float = 0.25, size: int = 50_000) -> DataFrame:
    """src, dst, score: the ``k`` texts most like each of ``queries`` (id; all texts without it) by TF-IDF cosine of at least ``least``.

    Queries meet all rows in blocks; score has 4 places; a text is no neighbour of itself.
    """
    rows, vocab = tfidf(docs, size)
    q = (rows if queries is None else rows.join(queries.select("id").distinct(), "id", "left_semi")).withColumnRenamed("id", "qid")
    top = blocks.sparse_topk(rows, q, k, 9, least, same=False, idf=vocab.idf)
    return top.select(F.col("qid").alias("src"), F.col("id").alias("dst"), F.round("score", 4).alias("score"))


def coverage_topk(docs: DataFrame, queries: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """qid, id, score, rank: share of a query's distinct words (over two characters) that a text has.

    ``by``: a column of ``docs`` for each value of which the ``k`` best are sought; it is in the result.
    """
    words = lambda t: F.array_distinct(F.filter(T.terms(t), lambda w: F.length(w) > 2))
    ones = F.transform("terms", lambda _: F.lit(1.0))
    q = cut(queries.select("qid", words(F.col("text")).alias("terms")).where(F.size("terms") > 0).withColumn("ws", ones), "asked")
    d = docs.select("id", words(F.col("text")).alias("terms"), *([by] if by else [])).where(F.size("terms") > 0).withColumn("ws", ones)
    hits = blocks.sparse_topk(d, q, k, 0, 1, by=by, whole=True)
    return hits.join(q.select("qid", F.size("terms").alias("n")).distinct(), "qid").select("qid", "id", F.round(F.col("score") / F.col("n"), 6).alias("score"), "rank", *([by] if by else []))


def best_sentences(hits: DataFrame, limit: int = 6, split=T.sentences) -> DataFrame:
    """qid, n, id, sentence: the sentences of the hits (qid, question, id, rank, text) that cover the question best.

    Sentences of less than 20 characters and without coverage are left out, and of those that start with the same
    160 characters the first stays.
    """
    s = hits.select("qid", "question", "id", "rank", F.posexplode(split(F.col("text"))).alias("pos", "sentence")).where(F.length("sentence") >= 20)
    s = s.withColumn("score", F.round(T.coverage(F.col("question"), F.col("sentence")), 6)).where("score > 0")
    order = [F.desc("score"), F.col("rank"), F.col("pos")]
    s = s.withColumn("d", F.row_number().over(Window.partitionBy("qid", F.substring("sentence", 1, 160)).orderBy(*order))).where("d = 1")
    return s.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("n") <= limit).select("qid", "n", "id", "sentence", "score")
