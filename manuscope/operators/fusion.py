"""Fusion of dense, lexical and graph scores; packing of context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def minmax(scores: DataFrame, by: str = "qid", score: str = "score") -> DataFrame:
    """``scores`` with ``norm``: (v - min) / (max - min) within ``by``; 1 where all are equal."""
    w = Window.partitionBy(by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return scores.withColumn("norm", F.when(hi == lo, 1.0).otherwise((F.col(score) - lo) / (hi - lo)))


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")))


def hybrid(dense: DataFrame, lexical: DataFrame, ws: float = 0.6, wb: float = 0.4) -> DataFrame:
    """qid, id, score, rank of the weighted union of two normalised score lists (qid, id, score); not cut to k."""
    a = minmax(dense).select("qid", "id", F.col("norm").alias("s"))
    b = minmax(lexical).select("qid", "id", F.col("norm").alias("b"))
    score = F.round(ws * F.coalesce("s", F.lit(0.0)) + wb * F.coalesce("b", F.lit(0.0)), 6)
    return _ranked(a.join(b, ["qid", "id"], "full_outer").select("qid", "id", score.alias("score")))


def graph_fused(seeds: DataFrame, neighbours: DataFrame, alpha: float = 0.65, beta: float = 0.35) -> DataFrame:
    """qid, id, score, rank: seeds (qid, id, score) fused with the best score of each neighbour (qid, dst, score)."""
    g = neighbours.groupBy("qid", F.col("dst").alias("id")).agg(F.max("score").alias("score"))
    a = minmax(seeds).select("qid", "id", F.col("norm").alias("h"))
    b = minmax(g).select("qid", "id", F.col("norm").alias("g"))
    score = F.round(alpha * F.coalesce("h", F.lit(0.0)) + beta * F.coalesce("g", F.lit(0.0)), 6)
    return _ranked(a.join(b, ["qid", "id"], "full_outer").select("qid", "id", score.alias("score")))


def split_kinds(fused: DataFrame, seeds: DataFrame, least_texts: int = 8, images: int = 6) -> DataFrame:
    """The fused rows cut to max(``least_texts``, seeds) texts (T_…) and ``images`` images (I_…), with their kind and place."""
    n = seeds.groupBy("qid").agg(F.count("*").alias("seeds"))
    kind = F.when(F.startswith("id", F.lit("T_")), "text").when(F.startswith("id", F.lit("I_")), "image")
    f = fused.withColumn("kind", kind).where("kind is not null").join(n, "qid", "left")
    f = f.withColumn("place", F.row_number().over(Window.partitionBy("qid", "kind").orderBy("rank")))
    most = F.when(F.col("kind") == "text", F.greatest(F.lit(least_texts), F.coalesce("seeds", F.lit(0)))).otherwise(images)
    return f.where(F.col("place") <= most).select("qid", "id", "score", "kind", "place")


def pack_context(texts: DataFrame, most: int = 3500) -> DataFrame:
    """qid, id, rank, upto of the texts (qid, id, rank, text) that fit before the first that exceeds ``most`` characters."""
    w = Window.partitionBy("qid").orderBy("rank", "id")
    upto = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    over = texts.withColumn("upto", upto).withColumn("over", F.max((F.col("upto") > most).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return over.where("over = 0").select("qid", "id", "rank", "upto")
