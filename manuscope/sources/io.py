"""Readers and writers: JSON lines, CSV, text, JSON objects, vectors, images, reports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(), "ARRAY<FLOAT>": T.ArrayType(T.FloatType())}


def _schema(ddl: str) -> T.StructType:
    """A schema of simple types, without a session."""
    return T.StructType([T.StructField(*(n, _TYPES[t])) for n, t in (x.split() for x in ddl.split(","))])


CHUNK = _schema("id STRING, method STRING, start_token INT, end_token INT, n_tokens INT, text STRING")
META = _schema("row_id INT, id STRING, method STRING, start_token INT, end_token INT, n_tokens INT")
TEXT_NODE = _schema("chunk_id STRING, page INT, tokens INT, text STRING")
IMAGE_NODE = _schema("img_id STRING, page INT, path STRING")
TEXT_IMAGE = _schema("chunk_id STRING, img_id STRING, score DOUBLE, method STRING")
TEXT_TEXT = _schema("src_chunk_id STRING, dst_chunk_id STRING, cosine DOUBLE")
MANIFEST = _schema("id STRING, page INT, xref INT, file_path STRING, width BIGINT")
VECTORS = _schema("row_id INT, id STRING, embedding ARRAY<FLOAT>, embedder STRING")

#: Names under which a node file may hold its columns, in order of preference.
NODE_ALIASES = {"text": ("text", "content", "chunk", "body"), "chunk_id": ("chunk_id", "id"), "page": ("page", "page_num", "pageid")}


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = CHUNK) -> DataFrame:
    """Rows of a JSON-lines file; a broken line gives a row of nulls."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path, ignoreNullFields=False)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV file with a header; quoted fields may hold line feeds.  Values that don't fit the schema are null."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    if schema is None:
        return df
    return df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_nodes_csv(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, page, text of a node file whose columns go by any of their known names, in any case."""
    df = read_csv(spark, path)
    by = {c.lower(): c for c in df.columns}
    types = {"text": "string", "chunk_id": "string", "page": "int"}
    out = []
    for name, names in NODE_ALIASES.items():
        found = [F.col(f"`{by[n]}`").try_cast(types[name]) for n in names if n in by]
        out.append((F.coalesce(*found) if found else F.lit(None).cast(types[name])).alias(name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One CSV file a partition with a header; an empty table gives a header only."""
    df.write.mode(mode).csv(path, header=True, escape='"')


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """question: the trimmed lines of a file that aren't blank."""
    return spark.read.text(path).select(F.trim("value").alias("question")).where("question <> ''")


def write_text(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    df.select(column).write.mode(mode).text(path)


def to_json_object(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row ``json``: an object of all keys; meant for tables of a bounded number of keys."""
    return df.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))).alias("json"))


def from_json_object(df: DataFrame, column: str = "json", value_type: str = "string") -> DataFrame:
    """key, value rows of JSON objects."""
    return df.select(F.explode(F.from_json(column, f"map<string,{value_type}>")).alias("key", "value"))


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, content of the files below a folder whose name fits ``glob``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def read_vectors(spark: SparkSession, path: str, embedder: str | None = None) -> DataFrame:
    """A vector index; with ``embedder`` rows of other models raise an error when they are read."""
    df = spark.read.schema(VECTORS).parquet(path)
    if embedder is None:
        return df
    same = F.when(F.col("embedder") == embedder, F.col("embedding")).otherwise(F.raise_error(F.lit(f"vectors were not made by {embedder}")))
    return df.withColumn("embedding", same.cast("array<float>"))


def write_vectors(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select("row_id", "id", "embedding", "embedder").write.mode(mode).parquet(path)


def first_existing(paths: list[str]) -> str | None:
    """The first path that exists on the driver's file system."""
    return next((p for p in paths if os.path.exists(p)), None)


def decode_pages(files: DataFrame, decoders: list) -> DataFrame:
    """path, page, text, error of files (path, content): the first decoder that gives pages wins.

    A decoder takes bytes and returns a list of page texts, or None if it can't read the file; a page that failed is
    None and becomes an empty text.
    """
    import pandas as pd

    def run(batches):
        for df in batches:
            rows = []
            for path, content in zip(df["path"], df["content"]):
                pages, error = None, "no decoder"
                for d in decoders:
                    try:
                        pages = d(bytes(content))
                    except Exception as e:  # the next decoder may do better
                        error = f"{type(e).__name__}: {e}"
                    if pages is not None:
                        break
                if pages is None:
                    rows.append((path, None, None, error))
                else:
                    rows += [(path, i, t or "", None) for i, t in enumerate(pages, 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, error string")


def html_text(content: bytes) -> list[str]:
    """A decoder for HTML files: the text without tags, as one page."""
    import html
    import re

    s = content.decode("utf-8", "replace")
    s = re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", s)
    s = re.sub(r"(?i)</(?:p|div|li|tr|h\d)>|<br\s*/?>", "\n", s)
    return [html.unescape(re.sub(r"<[^>]+>", " ", s)).strip()]
