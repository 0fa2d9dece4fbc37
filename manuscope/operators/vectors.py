"""Exact vector search in blocks, and vectors of texts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks


class Embedder(Protocol):
    """Turns texts into unit vectors; ``name`` is kept with the vectors and checked on search."""

    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashedWords:
    """The offline default: counts of words and word pairs hashed to ``dim`` places, unit length."""

    def __init__(self, dim: int = 256) -> None:
        self.dim, self.name = dim, f"hashed-words-{dim}"

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            ws = re.findall(r"\w\w+", (t or "").lower())
            for w in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]:
                out[i, zlib.crc32(w.encode()) % self.dim] += 1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


def embed(df: DataFrame, text: str = "text", embedder: Embedder | None = None) -> DataFrame:
    """``df`` with columns ``embedding`` and ``embedder``."""
    e = embedder or HashedWords()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = e.encode(b[at].to_pylist())
            arr = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, e.dim, dtype=np.int32)), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, arr, pa.array([e.name] * len(b))], names=[*b.schema.names, "embedding", "embedder"])

    return df.mapInArrow(run, f"{schema}, embedding array<float>, embedder string")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null if a side is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """The vector divided by its length (plus 1e-9, so that zero stays zero)."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) + 1e-9
    return F.transform(v, lambda x: x.cast("double") / n)


def topk(corpus: DataFrame, queries: DataFrame, k: int, id_col: str = "id", allow: DataFrame | None = None) -> DataFrame:
    """qid, id, score, rank: the ``k`` largest inner products of each query, ties by id; score rounded to 6 places.

    ``corpus``: ``id_col`` and embedding; ``queries``: qid and embedding, a stated set that is compared with all rows
    in blocks.  ``allow`` (qid, id): what a query may
    find; a query without rows there finds nothing.  Rows without a vector, and a row of a query's own, are no
    special case: filter them before.  Fewer than k rows give fewer results.
    """
    qtype, itype = queries.schema["qid"].dataType.simpleString(), corpus.schema[id_col].dataType.simpleString()
    c = corpus.select(F.col(id_col).alias("id"), "embedding").where("embedding is not null")
    q = queries.select("qid", "embedding").where("embedding is not null")
    if allow is not None:
        # the allowed rows come before the ranking, so that none of the k is lost
        pairs = allow.select("qid", "id").distinct().join(c, "id").join(q.withColumnRenamed("embedding", "qv"), "qid")
        scored = pairs.select("qid", "id", F.round(dot(F.col("embedding"), F.col("qv")), 6).alias("score"))
        w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return blocks.topk(c, q, k, blocks.dense, 6, float("-inf"))


def edge_cosines(edges: DataFrame, vectors: DataFrame, src: str, dst: str) -> tuple[DataFrame, DataFrame]:
    """(edges with ``weight``, the inner product of their ends' vectors; edges that lack a vector)."""
    v = vectors.select("id", "embedding").where("embedding is not null")
    both = edges.join(v.select(F.col("id").alias(src), F.col("embedding").alias("_a")), src, "left").join(v.select(F.col("id").alias(dst), F.col("embedding").alias("_b")), dst, "left")
    whole = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.where(whole).withColumn("weight", dot(F.col("_a"), F.col("_b"))).drop("_a", "_b"), both.where(~whole).drop("_a", "_b")
