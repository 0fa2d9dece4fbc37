"""Registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks (rec_table 0) and text nodes (rec_table 1); a record's repeated rows all have one text."""
    chunks = read(spark, sf_dir, "who_chunks_semantic").select(F.lit(0).alias("rec_table"), F.col("id").alias("rec_id"), "text")
    nodes = read(spark, sf_dir, "nodes_text").select(F.lit(1).alias("rec_table"), F.col("chunk_id").alias("rec_id"), "text")
    return chunks.union(nodes)


def named(df: DataFrame) -> DataFrame:
    return df.withColumn("rec_table", F.when(F.col("rec_table") == 0, "who_chunks_semantic").otherwise("nodes_text"))


def _alike(spark: SparkSession, sf_dir: str):
    from .near_duplicates import near_duplicates

    return near_duplicates(records(spark, sf_dir), threshold=0.5, width=3)


@query
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import record_pairs

    return named(record_pairs(_alike(spark, sf_dir))).select("rec_table", "rec_a", "rec_b")


@query
def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record: its class of exact copies, its group, its number of links to other classes."""
    from .near_duplicates import record_groups

    return named(record_groups(_alike(spark, sf_dir)))


@query
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .answers import broken_answers

    return broken_answers(read(spark, sf_dir, "answer"))


@query
def p2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs and mean stated confidence (of those in range) by defect; sound pairs count as ``none``."""
    from .answers import broken_answers

    pairs = read(spark, sf_dir, "answer")
    stated = F.when(F.col("confidence").between(0, 1), F.col("confidence"))
    return (
        pairs.select("answer_id", stated.alias("confidence"))
        .join(broken_answers(pairs), "answer_id", "left")
        .groupBy(F.coalesce("defect", F.lit("none")).alias("defect"))
        .agg(F.count("*").alias("pairs"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))
    )


@query
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .residue import template_residue

    return template_residue(read(spark, sf_dir, "documents")).select("doc_id")


@query
def p10_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that stay when those with residue are left out."""
    from .residue import without_residue

    return without_residue(read(spark, sf_dir, "documents")).select("doc_id", "source", "lang")


def limits(spark: SparkSession, sf_dir: str) -> dict[str, tuple[int, int]]:
    """The size limits by name: a table of three rows."""
    return {r["limit_name"]: (r["max_tokens"], r["overlap_tokens"]) for r in read(spark, sf_dir, "size_limits").collect()}


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .splitting import split_oversized

    limit, overlap = limits(spark, sf_dir)["chunk_split"]
    return split_oversized(read(spark, sf_dir, "who_chunks_semantic"), limit, overlap)


@query
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("piece_no = 0").select("id")


SQL["p3_found"] = r"""
SELECT DISTINCT id FROM who_chunks_semantic WHERE len(regexp_extract_all(text, '[^ \t\n\r\f]+')) > 1000"""


@query
def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..runtime import cut
    from .sizes import sized

    return cut(sized(read(spark, sf_dir, "documents")), "sized")


#: Share of a container's tokens that may bear loss; above the share in the texts (about 0.77), so that room for it can be filled.
LOSS_SHARE = 0.9


@query
def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers under limits on tokens, segments and loss-bearing tokens."""
    from .packing import pack

    items, lim, out = _sized(spark, sf_dir), limits(spark, sf_dir), None
    for name, segments in (("pack_small", 8), ("pack_large", 64)):
        one = pack(items, lim[name][0], segments, LOSS_SHARE).select(F.lit(name).alias("limit_name"), "*")
        out = one if out is None else out.union(one)
    return out


@query
def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and fill of each limit; the limit on loss-bearing tokens, the most that a container holds, and how many stand at it."""
    lim = {k: v[0] for k, v in limits(spark, sf_dir).items()}
    boxes = p8_pack(spark, sf_dir).groupBy("limit_name", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.sum("loss_tokens").alias("l"))
    cap = F.create_map(*[F.lit(x) for kv in lim.items() for x in kv])[F.col("limit_name")]
    most = F.create_map(*[F.lit(x) for k, v in lim.items() for x in (k, max(1, int(v * LOSS_SHARE)))])[F.col("limit_name")]
    return boxes.groupBy("limit_name").agg(
        F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"), F.max("n").alias("most_segments"), F.round(F.sum("t") / (F.count("*") * F.max(cap)), 4).alias("fill"),
        F.max(most).alias("loss_limit"), F.max("l").alias("most_loss"), F.count_if(F.col("l") == most).alias("at_loss_limit"),
    )


def _mixed(spark: SparkSession, sf_dir: str):
    from .mixing import mix

    items = _sized(spark, sf_dir).withColumn("weight", 0.25 + F.col("letters") * F.least(F.lit(1.0), F.col("tokens") / 256))
    return mix(items, read(spark, sf_dir, "mix_targets"))


@query
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


@query
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mixed(spark, sf_dir)[1]


@query
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..runtime import cut
    from .neighbours import nearest, usable

    pairs = nearest(cut(usable(read(spark, sf_dir, "chunk_vectors"), "chunk_id", "row_id"), "units"), k=5, floor=0.85, recall=0.998)
    return pairs.select(F.least("id", "other").alias("chunk_a"), F.greatest("id", "other").alias("chunk_b")).distinct()


@query
def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar chunks of every chunk whose number is divisible by 20, with the exported cosine of the edge where there is one."""
    from ..runtime import cut
    from .neighbours import nearest, usable

    units = cut(usable(read(spark, sf_dir, "chunk_vectors"), "chunk_id", "row_id"), "units")
    asked = units.where(F.try_to_number(F.substring("id", 3, 20), F.lit("99999999999999999999")) % 20 == 0).select("id")
    stored = read(spark, sf_dir, "rel_text_text").groupBy(F.col("src_chunk_id").alias("id"), F.col("dst_chunk_id").alias("other")).agg(F.max(F.when(F.col("cosine").between(-1, 1), F.col("cosine"))).alias("stored_cosine"))
    return nearest(units, k=5, recall=0.95, queries=asked).join(stored, ["id", "other"], "left").select("id", "other", "rank", "cosine", "stored_cosine")


@query
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shared_spans import shared_spans

    return named(shared_spans(records(spark, sf_dir), 200)[0].select("rec_table", "rec_id").distinct())


@query
def p7_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each record's text occurs in other records of its table; 0 where nothing does."""
    from .shared_spans import record_shares, shared_spans

    r = records(spark, sf_dir)
    return named(record_shares(r, shared_spans(r, 200)[1]))


@query
def p7_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's text without the spans that occur in other records of its table."""
    from .shared_spans import shared_spans, without_spans

    r = records(spark, sf_dir)
    return named(without_spans(r, shared_spans(r, 200)[0]))


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .scan_noise import read_scans

    chunks = read(spark, sf_dir, "who_chunks_semantic").select(F.lit(0).alias("rec_table"), F.col("id").alias("rec_id"), "manual", "text")
    nodes = read(spark, sf_dir, "nodes_text").select(F.lit(1).alias("rec_table"), F.col("chunk_id").alias("rec_id"), "manual", "text")
    return read_scans(chunks.union(nodes), read(spark, sf_dir, "manuals"))


@query
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named(_read(spark, sf_dir).select("rec_table", "rec_id", F.explode("kinds").alias("noise")).distinct())


@query
def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's text as continuous paragraphs."""
    return named(_read(spark, sf_dir).select("rec_table", "rec_id", "text").distinct())


_RECORDS = """r AS (SELECT 'who_chunks_semantic' AS rec_table, id AS rec_id, max(text) AS text FROM who_chunks_semantic WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id
  UNION ALL SELECT 'nodes_text', chunk_id, max(text) FROM nodes_text WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY chunk_id)"""

SQL["p1_found"] = f"""
WITH {_RECORDS}, w AS (SELECT rec_table, rec_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM r),
g AS (SELECT DISTINCT rec_table, rec_id, hash(w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT rec_table, rec_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
n AS (SELECT rec_table, rec_id, count(*) AS n FROM g GROUP BY ALL),
p AS (SELECT a.rec_table, a.rec_id AS rec_a, b.rec_id AS rec_b, count(*) AS both_ FROM g a JOIN g b ON a.rec_table = b.rec_table AND a.g = b.g AND a.rec_id < b.rec_id GROUP BY ALL)
SELECT p.rec_table, rec_a, rec_b FROM p JOIN n x ON x.rec_table = p.rec_table AND x.rec_id = rec_a JOIN n y ON y.rec_table = p.rec_table AND y.rec_id = rec_b WHERE 2 * both_ >= x.n + y.n - both_"""

SQL["p7_found"] = f"""
WITH {_RECORDS}, s AS (SELECT rec_table, rec_id, hash(substring(text, i, 200)) AS h FROM (SELECT rec_table, rec_id, text, unnest(range(1, length(text) - 198)) AS i FROM r WHERE length(text) >= 200)),
d AS (SELECT rec_table, h FROM s GROUP BY ALL HAVING count(DISTINCT rec_id) > 1)
SELECT DISTINCT rec_table, rec_id FROM s JOIN d USING (rec_table, h)"""

SQL["p7_share"] = f"""
WITH ids AS (SELECT 'who_chunks_semantic' AS rec_table, id AS rec_id, coalesce(max(length(text)), 0) AS chars FROM who_chunks_semantic WHERE id IS NOT NULL GROUP BY id
  UNION ALL SELECT 'nodes_text', chunk_id, coalesce(max(length(text)), 0) FROM nodes_text WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
{_RECORDS}, s AS (SELECT rec_table, rec_id, i, hash(substring(text, i, 200)) AS h FROM (SELECT rec_table, rec_id, text, unnest(range(1, length(text) - 198)) AS i FROM r WHERE length(text) >= 200)),
d AS (SELECT rec_table, h FROM s GROUP BY ALL HAVING count(DISTINCT rec_id) > 1), w AS (SELECT s.rec_table, rec_id, i FROM s JOIN d USING (rec_table, h)),
c AS (SELECT rec_table, rec_id, sum(least(200, n - i)) AS shared_chars FROM (SELECT *, coalesce(lead(i) OVER (PARTITION BY rec_table, rec_id ORDER BY i), i + 200) AS n FROM w) GROUP BY ALL)
SELECT rec_table, rec_id, CAST(chars AS INT) AS chars, CAST(coalesce(shared_chars, 0) AS BIGINT) AS shared_chars, CASE WHEN coalesce(shared_chars, 0) = 0 THEN 0.0 ELSE CAST(shared_chars AS DOUBLE) / chars END AS share FROM ids LEFT JOIN c USING (rec_table, rec_id)"""
