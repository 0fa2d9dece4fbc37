"""Cleaning of page texts: furniture lines, unwrapping, statistics.  Pages are rows (doc, page, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def page_lines(pages: DataFrame) -> DataFrame:
    """doc, page, line_no, line of each line; null texts have none."""
    return pages.select("doc", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def repeated_lines(pages: DataFrame, ratio: float = 0.3, edge: int = 3) -> DataFrame:
    """doc, line, top, bottom: lines among the first or last ``edge`` non-empty ones of enough pages.

    Enough is max(3, ratio * pages).  Occurrences count, not pages; lines of less than 3 characters don't.
    """
    lines = page_lines(pages).withColumn("line", F.trim("line")).where("line <> ''")
    by = Window.partitionBy("doc", "page")
    lines = lines.withColumn("up", F.row_number().over(by.orderBy("line_no"))).withColumn("down", F.row_number().over(by.orderBy(F.desc("line_no"))))
    seen = lines.where("length(line) >= 3").groupBy("doc", "line").agg(F.count_if(F.col("up") <= edge).alias("top"), F.count_if(F.col("down") <= edge).alias("bottom"))
    enough = pages.groupBy("doc").agg(F.greatest(F.lit(3), F.floor(F.count("*") * F.lit(ratio))).alias("least"))
    return seen.join(enough, "doc").where("top >= least or bottom >= least").select("doc", "line", "top", "bottom")


def drop_edge_lines(pages: DataFrame, ratio: float = 0.3, edge_window: int = 8) -> DataFrame:
    """doc, page, line_no, line without repeated lines and page numbers near the top and bottom of pages."""
    lines = page_lines(pages).withColumn("n", F.count("*").over(Window.partitionBy("doc", "page")))
    lines = lines.withColumn("key", F.trim("line"))
    bad = repeated_lines(pages, ratio).select("doc", F.col("line").alias("key"), F.lit(True).alias("repeated"))
    at_edge = (F.col("line_no") < edge_window) | (F.col("line_no") > F.col("n") - edge_window - 1)
    furniture = F.coalesce("repeated", F.lit(False)) | T.is_page_number(F.col("key"))
    return lines.join(bad, ["doc", "key"], "left").where(~(at_edge & furniture)).select("doc", "page", "line_no", "line")


def unwrap(lines: DataFrame) -> DataFrame:
    """Paragraphs from lines: doc, page, para, text.

    A paragraph goes on until a line ends in a closing mark; blank lines end it too.  Gaps and islands over the lines.
    """
    by = Window.partitionBy("doc", "page").orderBy("line_no")
    s = lines.withColumn("line", F.trim("line"))
    before = F.lag("line").over(by)
    start = before.isNull() | (before == "") | before.rlike(r"[.!?:;)\]}»]\z") | (F.col("line") == "")
    s = s.withColumn("para", F.sum(start.cast("int")).over(by)).where("line <> ''")
    return s.groupBy("doc", "page", "para").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ").alias("text"))


def clean_pages(pages: DataFrame, ratio: float = 0.3, edge_window: int = 8) -> DataFrame:
    """doc, page, text: pages without furniture, de-hyphenated, unwrapped and squeezed."""
    norm = pages.withColumn("text", T.normalize(T.nfkc(F.col("text"))))
    kept = drop_edge_lines(norm, ratio, edge_window)
    joined = kept.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))
    joined = joined.withColumn("text", T.dehyphenate(F.col("text")))
    paras = unwrap(page_lines(joined))
    whole = paras.groupBy("doc", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return whole.withColumn("text", T.squeeze(F.col("text")))


def render(pages: DataFrame) -> DataFrame:
    """doc, text: pages joined with the page-break marker between them."""
    marker = f"\n\n{T.BREAK}\n\n"
    return pages.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), marker).alias("text"))


def stats(docs: DataFrame, head: int = 120) -> DataFrame:
    """doc, chars, words, lines and the first ``head`` lines of each text."""
    lines = F.split("text", "\n")
    count = lambda c: c.cast("long")
    return docs.select(
        "doc", count(F.length("text")).alias("chars"), count(F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f]+"), F.lit(0)))).alias("words"), count(F.size(lines)).alias("lines"), F.array_join(F.slice(lines, 1, head), "\n").alias("preview_head")
    )
