"""Image manifests: decoders, checks, page maps and addresses."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PNG = "89504E470D0A1A0A"


class Image(NamedTuple):
    page: int
    number: int
    width: int
    height: int
    content: bytes


class Decoder(Protocol):
    """Reads the pictures of a file; several are tried in turn until one gives a result."""

    def __call__(self, content: bytes) -> Iterable[Image]: ...


def extract(files: DataFrame, decoders: list[Decoder], least_side: int = 32, per_page: int = 100) -> DataFrame:
    """path, page, xref, width, height, sha1, content, error of the pictures in ``files`` (path, content).

    Pictures with a known side below ``least_side`` are skipped, of each page the first ``per_page`` stay; a file
    that no decoder can read gives one row with its error.
    """

    def run(batches):
        for df in batches:
            rows = []
            for path, content in zip(df["path"], df["content"]):
                error, found = "no decoder", None
                for d in decoders:
                    try:
                        found = list(d(bytes(content)))
                        break
                    except Exception as e:  # a broken file is a row, not a failed job
                        error = f"{type(e).__name__}: {e}"
                if found is None:
                    rows.append((path, None, None, None, None, None, error))
                else:
                    rows += [(path, x.page, x.number, x.width, x.height, x.content, None) for x in found if not 0 < min(x.width, x.height) < least_side]
            yield pd.DataFrame(rows, columns=["path", "page", "xref", "width", "height", "content", "error"])

    out = files.select("path", "content").mapInPandas(run, "path string, page int, xref int, width int, height int, content binary, error string")
    w = Window.partitionBy("path", "page").orderBy("xref")
    return out.withColumn("n", F.row_number().over(w)).where(F.col("error").isNotNull() | (F.col("n") <= per_page)).withColumn("sha1", F.substring(F.sha1("content"), 1, 12)).drop("n")


def is_png(content: Column, least_bytes: int = 256) -> Column:
    """Whether bytes are a PNG file larger than ``least_bytes``, by its signature."""
    return (F.octet_length(content) > least_bytes) & F.startswith(F.hex(content), F.lit(PNG))


def verify(files: DataFrame, least_bytes: int = 256) -> DataFrame:
    """path, ok of ``files`` (path, content)."""
    return files.select("path", F.coalesce(is_png(F.col("content"), least_bytes), F.lit(False)).alias("ok"))


def page_map(images: DataFrame, by: str = "manual") -> DataFrame:
    """by, page, paths: the distinct paths of each page in their order; rows without page or path are left out."""
    i = images.where(F.col("page").isNotNull() & F.col("path").isNotNull() & F.col(by).isNotNull())
    return i.groupBy(by, "page").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def image_nodes(pages: DataFrame, prefix: str = "") -> DataFrame:
    """img key, page, path of a page map (page STRING, paths): digits of the key as page, -1 without any."""
    digits = F.regexp_extract("page", r"(\d+)", 1)
    rows = pages.select("page", F.posexplode("paths").alias("pos", "path"))
    return rows.select(F.coalesce(F.nullif(digits, F.lit("")).cast("int"), F.lit(-1)).alias("page"), "pos", F.concat(F.lit(prefix), "path").alias("path"))


def url(path: Column, base: str = "/static/") -> Column:
    """``base`` and the last part of a path, of either separator; null for a null or empty name."""
    name = F.element_at(F.split(path, r"[\\/]"), -1)
    return F.when(name != "", F.concat(F.lit(base), name))
