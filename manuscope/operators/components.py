"""Connected components of an edge list, without ever gathering a component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Labels each vertex of ``edges`` with the smallest vertex of its component.

    Large-star / small-star contraction: each round re-hangs edges below the smallest
    neighbour, so the number of rounds grows with the logarithm of the diameter.  All steps
    are aggregations and joins on vertex keys; each round is cut into a written table.

    Null endpoints are ignored, self loops give a component of one, an empty edge list gives
    an empty result.  Columns: ``vertex``, ``component``.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    vertices = e.select(F.explode(F.array("u", "v")).alias("vertex")).distinct()
    e = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    seen = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = cut(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return vertices.join(e.groupBy(F.col("u").alias("vertex")).agg(F.min("v").alias("component")), "vertex", "left").select(
        "vertex", F.coalesce("component", "vertex").alias("component")
    )
