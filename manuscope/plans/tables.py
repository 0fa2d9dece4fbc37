"""What the queries read: test tables in the shapes that the operators take, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import partitions, read, spread

QUESTIONS = [
    "What is biosafety level 2?",
    "What is the difference between a freezer and a refrigerator?",
    "Compare bsl-2 and bsl-3",
    "How to sterilize an autoclave",
    "Staining of blood films",
    "Why is PPE required?",
    "How does a centrifuge work?",
    "Where is the centrifuge?",
    "WHO guidelines",
    "centrifuge maintenance",
    "Can gloves be reused?",
    "What is the heavy cylinder for?",
    "How to keep the culture in the ventilated store",
    "What does the protective equipment cover?",
]
_VALUES = ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS, 1))
#: The sample questions with negative numbers, and the logged ones: all, or the stated queries whose number is divisible by 20.
_SAMPLES = f"SELECT CAST(-qid AS BIGINT) AS qid, question FROM (VALUES {_VALUES}) v(qid, question)"
SQL_EVERY = f"questions AS ({_SAMPLES} UNION ALL SELECT answer_id, question FROM answer WHERE question IS NOT NULL)"
SQL_QUESTIONS = f"questions AS ({_SAMPLES} UNION ALL SELECT answer_id, question FROM answer WHERE question IS NOT NULL AND answer_id % 20 = 0)"
SQL_DOCS = "docs AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL)"
SQL_ASKED = "asked AS (SELECT answer_id AS qid, question AS text FROM answer WHERE answer_id % 20 = 0 AND question IS NOT NULL)"
SQL_NODES = "nodes AS (SELECT chunk_id AS id, max(manual) AS manual, CAST(max(page) AS BIGINT) AS page, max(text) AS text FROM nodes_text WHERE text IS NOT NULL AND chunk_id IS NOT NULL GROUP BY chunk_id)"
TERM = r"[\p{L}\p{N}_]{2,}"
SQL_WORDS = f"list_distinct(list_filter(regexp_extract_all(lower(text), '{TERM}'), lambda x: length(x) > 2))"


def sql_grams(table: str) -> str:
    """id and the list of words and word pairs of a table's texts."""
    return f"(SELECT id, w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]) AS g FROM (SELECT id, regexp_extract_all(lower(text), '{TERM}') AS w FROM {table}))"


def samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(-i, q) for i, q in enumerate(QUESTIONS, 1)], "qid long, question string").coalesce(1)


def every_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample questions and all logged ones."""
    return samples(spark).union(read(spark, sf_dir, "answer").where("question is not null").select(F.col("answer_id").alias("qid"), "question"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample questions and the stated queries, for what searches the nodes."""
    return samples(spark).union(asked(spark, sf_dir).select("qid", F.col("text").alias("question")))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries: logged questions whose answer_id is divisible by 20."""
    return read(spark, sf_dir, "answer").where("answer_id % 20 = 0 and question is not null").select(F.col("answer_id").alias("qid"), F.col("question").alias("text"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per text node with a text."""
    n = read(spark, sf_dir, "nodes_text").where("text is not null and chunk_id is not null").select("chunk_id", "manual", "page", "text")
    n = n.repartition(partitions(spark), "chunk_id")  # the grouping's own shuffle, which is not to shrink to one task
    return n.groupBy(F.col("chunk_id").alias("id")).agg(F.max("manual").alias("manual"), F.max("page").cast("long").alias("page"), F.max("text").alias("text"))


def longs(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, as SQL counts them."""
    return df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])
