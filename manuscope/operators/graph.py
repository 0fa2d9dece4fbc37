"""The property graph as vertex and edge tables: upserts, neighbours, fetches, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def upsert_nodes(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Old and new rows, of each key the last by ``order``; ties go to the new rows, then to the larger row."""
    cols = old.columns
    rows = old.withColumn("_batch", F.lit(0)).union(new.select(*cols).withColumn("_batch", F.lit(1)))
    last = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, "_batch", *[c for c in cols if c not in (key, order)])).alias("_r"))
    return last.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in cols])


def upsert_edges(old: DataFrame, new: DataFrame, src: str, dst: str, order: str, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """As :func:`upsert_nodes` for edges, and only those whose ends are in ``sources`` and ``targets`` (id)."""
    cols = old.columns
    both = old.withColumn("_batch", F.lit(0)).union(new.select(*cols).withColumn("_batch", F.lit(1))).where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    last = both.groupBy(src, dst).agg(F.max(F.struct(order, "_batch", *[c for c in cols if c not in (src, dst, order)])).alias("_r"))
    rows = last.select(*[F.col(c) if c in (src, dst) else F.col(f"_r.{c}").alias(c) for c in cols])
    rows = rows.join(sources.select(F.col("id").alias(src)).distinct(), src, "left_semi")
    return rows.join(targets.select(F.col("id").alias(dst)).distinct(), dst, "left_semi").select(*cols)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that break uniqueness, with their number of rows."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def neighbors(edges: DataFrame, seeds: DataFrame, limit: int = 50, types: tuple[str, ...] = ("SIMILAR_TO", "HAS_IMAGE")) -> DataFrame:
    """seed, dst, rel_type, score: outgoing edges (src, dst, rel_type, score) of the seeds (id), best first.

    A null score counts as 0.  The limit holds before each neighbour is reduced to its best edge; ties by dst,
    then by type.  Edges are ranked after a semi-join, so only those of seeds are sorted.
    """
    e = edges.where(F.col("rel_type").isin(*types)).join(seeds.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    e = e.select("src", "dst", "rel_type", F.coalesce("score", F.lit(0.0)).alias("score"))
    w = Window.partitionBy("src").orderBy(F.desc("score"), "dst", "rel_type")
    e = e.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit)
    return e.groupBy(F.col("src").alias("seed"), "dst").agg(F.max(F.struct("score", "rel_type")).alias("b")).select("seed", "dst", "b.rel_type", "b.score")


def ordered_fetch(hits: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """The nodes of the hits (qid, id, rank) with their rank; hits without a node are dropped."""
    return hits.select("qid", key, "rank").join(nodes, key)


def ranked_images(texts: DataFrame, edges: DataFrame, images: DataFrame, limit: int = 3) -> DataFrame:
    """qid, img_id, path, score, rank: images of a query's texts (qid, id) by their best edge (chunk_id, img_id, score)."""
    e = texts.select("qid", F.col("id").alias("chunk_id")).distinct().join(edges, "chunk_id")
    best = e.groupBy("qid", "img_id").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score")).join(images, "img_id")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "img_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("qid", "img_id", "path", "score", "rank")


def page_match_edges(texts: DataFrame, images: DataFrame, score: float = 0.61) -> DataFrame:
    """chunk_id, img_id, score, method: texts and images of one page of one manual."""
    t = texts.select("manual", "page", "chunk_id").where("page > 0").distinct()
    i = images.select("manual", "page", "img_id").where("page > 0").distinct()
    return t.join(i, ["manual", "page"]).select("chunk_id", "img_id", F.lit(score).alias("score"), F.lit("page_match").alias("method"))


def bridges(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answer_id, chunk_id) and (answer_id, img_id): what an answer is based on and includes, each list by itself."""
    one = lambda c, n: answers.select("answer_id", F.explode(c).alias(n)).where(F.col(n).isNotNull()).distinct()
    return one("text_ids", "chunk_id"), one("image_ids", "img_id")


def recent_answers(answers: DataFrame, limit: int = 10) -> DataFrame:
    """The newest answers with the sorted distinct ids of their texts and images; answers without a time are not recent."""
    ids = lambda c: F.array_sort(F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())))
    rows = answers.where("answered_at is not null").select("answer_id", "question", "answer", "confidence", "answered_at", ids(F.col("text_ids")).alias("text_ids"), ids(F.col("image_ids")).alias("image_ids"))
    return rows.orderBy(F.desc("answered_at"), "answer_id").limit(limit)


def summary(tables: dict[str, DataFrame]) -> DataFrame:
    """what, n: the number of rows of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.union(one)
    return out


def norm_texts(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("text", T.norm_export(F.col("text")))
