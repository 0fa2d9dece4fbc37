"""Evidence bundles, answers, confidence and quality metrics."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T


class Generator(Protocol):
    """Makes ``answer`` for each question out of its contexts; the default is :func:`extractive`."""

    def __call__(self, contexts: DataFrame) -> DataFrame: ...


def bundles(evidence: DataFrame, most: int = 4, near: int = 3) -> DataFrame:
    """qid, bundle, pos, id, page, role, definition_score of evidence (qid, id, page, text, rank).

    Greedy first fit in the order of rank: a text joins the first open bundle (below ``most``) whose mean page is
    within ``near`` or whose first text has its role.  A fold over one question's evidence, a short sorted array.
    """
    score = F.size(T.indicators(F.col("text"))) / 12.0
    e = evidence.select("qid", F.struct("rank", "id", F.coalesce(F.col("page").cast("int"), F.lit(0)).alias("page"), T.bundle_role(F.col("text")).alias("role"), score.alias("score")).alias("x"))
    lists = e.groupBy("qid").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    place = f"""
        aggregate(xs, named_struct('bs', cast(array() as array<struct<role: string, pages: int, n: int>>), 'at', cast(array() as array<int>)), (acc, x) ->
            case when size(filter(acc.bs, b -> b.n < {most} and (abs(x.page - b.pages / b.n) <= {near} or b.role = x.role))) = 0
            then named_struct('bs', concat(acc.bs, array(named_struct('role', x.role, 'pages', x.page, 'n', 1))), 'at', concat(acc.at, array(size(acc.bs))))
            else named_struct(
                'bs', transform(acc.bs, (b, i) -> case when i = cast(array_position(transform(acc.bs, c -> c.n < {most} and (abs(x.page - c.pages / c.n) <= {near} or c.role = x.role)), true) as int) - 1
                    then named_struct('role', b.role, 'pages', b.pages + x.page, 'n', b.n + 1) else b end),
                'at', concat(acc.at, array(cast(array_position(transform(acc.bs, c -> c.n < {most} and (abs(x.page - c.pages / c.n) <= {near} or c.role = x.role)), true) as int) - 1))) end, acc -> acc.at)"""
    rows = lists.select("qid", F.explode(F.arrays_zip("xs", F.expr(place).alias("at"))).alias("z"))
    w = Window.partitionBy("qid", "bundle").orderBy("rank", "id")
    rows = rows.select("qid", F.col("z.at").alias("bundle"), "z.xs.rank", "z.xs.id", "z.xs.page", "z.xs.role", F.col("z.xs.score").alias("definition_score"))
    return rows.withColumn("pos", F.row_number().over(w)).select("qid", "bundle", "pos", "id", "page", "role", "definition_score")


def bundle_scores(b: DataFrame) -> DataFrame:
    """qid, bundle, score: definition score, few roles and close pages, weighed 0.4, 0.3, 0.3."""
    score = 0.4 * F.avg("definition_score") + F.when(F.count_distinct("role") <= 2, 0.3).otherwise(0.15) + 0.3 * F.greatest(F.lit(0.0), 1 - (F.max("page") - F.min("page")) / 10.0)
    return b.groupBy("qid", "bundle").agg(F.round(score, 6).alias("score"))


def flatten(b: DataFrame, most_bundles: int = 5, most: int = 10) -> DataFrame:
    """qid, place, id: the texts of the best bundles, bundle by bundle in their own order."""
    s = bundle_scores(b)
    s = s.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "bundle"))).where(F.col("r") <= most_bundles)
    f = b.join(s, ["qid", "bundle"])
    return f.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("r", "pos"))).where(F.col("place") <= most).select("qid", "place", "id")


def prompt(contexts: DataFrame) -> DataFrame:
    """qid, prompt: numbered contexts (qid, question, id, page, text, place) and the question."""
    one = F.format_string("[Text %d] (ID: %s, Page: %s):\n%s", "place", "id", F.coalesce(F.col("page").cast("string"), F.lit("?")), "text")
    parts = contexts.groupBy("qid").agg(F.max("question").alias("question"), F.array_sort(F.collect_list(F.struct("place", one.alias("t")))).alias("p"))
    return parts.select("qid", F.concat_ws("\n\n", F.concat_ws("\n\n", F.transform("p", lambda x: x["t"])), F.concat(F.lit("Question: "), "question")).alias("prompt"))


def extractive(contexts: DataFrame) -> DataFrame:
    """qid, answer: up to three sentences with a storage word; else the first two of the first context; else its first 300 characters."""
    parts = F.transform(F.split("text", r"[.!?]+\s+"), F.trim)
    s = contexts.select("qid", "place", F.posexplode(parts).alias("pos", "s")).where(F.length("s") > 10)
    s = s.withColumn("storage", F.size(F.array_intersect(T.words3(F.col("s")), F.array(*map(F.lit, L.STORAGE_WORDS)))) > 0)
    order = [F.col("place"), F.col("pos")]
    k = s.where("storage").withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where("n <= 3").withColumn("kind", F.lit(1))
    f = s.where("place = 1").withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where("n <= 2").withColumn("kind", F.lit(2))
    both = k.union(f).groupBy("qid", "kind").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: F.concat(x["s"], F.lit(".")))).alias("answer"))
    best = both.groupBy("qid").agg(F.min(F.struct("kind", "answer")).alias("b")).select("qid", "b.answer")
    head = contexts.where("place = 1").select("qid", F.substring("text", 1, 300).alias("head"))
    return head.join(best, "qid", "left").select("qid", F.coalesce("answer", "head").alias("answer"))


def confidence(answers: DataFrame, contexts: DataFrame) -> DataFrame:
    """qid, answer, confidence: share of the answer's words in the first five contexts, and its adjustments.

    At least five words add 0.2; a definition without a defining verb loses 0.3; below 0.3 a fixed text stands instead.
    ``answers``: qid, intent, answer.
    """
    words = contexts.where("place <= 5").groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list(T.words3(F.col("text"))))).alias("w"))
    a = answers.join(words, "qid", "left")
    mine = F.array_distinct(T.words3(F.col("answer")))
    none = F.array().cast("array<string>")
    share = F.when(F.size(mine) == 0, 0.0).otherwise(F.size(F.array_intersect(mine, F.coalesce("w", none))) / F.size(mine))
    share = F.when(F.size(F.regexp_extract_all("answer", F.lit(r"\S+"), F.lit(0))) >= 5, F.least(F.lit(1.0), share + 0.2)).otherwise(share)
    share = F.when((F.col("intent") == "definition") & ~F.col("answer").rlike("(?i)" + L.DEFINING_VERBS), F.greatest(F.lit(0.0), share - 0.3)).otherwise(share)
    low = (share < 0.3) & ~F.lower("answer").contains("don't")
    text = F.when(low, "Insufficient confidence in answer. Retrieved context may not contain accurate information.").otherwise(F.col("answer"))
    return a.select("qid", text.alias("answer"), F.round(F.when(low, 0.2).otherwise(share), 6).alias("confidence"))


_ALIGNED = {
    "definition": "(?i)" + L.DEFINING_VERBS,
    "procedure": r"(?i)\b(step|process|procedure|first|then|next|finally|\d+\.)\b",
    "comparison": r"(?i)\b(difference|differ|versus|vs|compared\s+to|contrast|while|whereas)\b",
}


def metrics(answers: DataFrame, sources: int = 10) -> DataFrame:
    """qid and the quality of an answer (qid, intent, core_concepts, answer): concepts named, alignment, citations, abstention."""
    a, low = F.col("answer"), F.lower("answer")
    named = F.size(F.filter("core_concepts", lambda c: F.contains(low, c)))
    relevance = F.when(F.size("core_concepts") == 0, 0.0).otherwise(F.round(100.0 * named / F.size("core_concepts"), 1))
    aligned = F.lit(False)
    for k, p in _ALIGNED.items():
        aligned = F.when(F.col("intent") == k, a.rlike(p)).otherwise(aligned)
    aligned = F.when(F.col("intent").isin("fact_lookup", "explanation", "yesno"), F.size(F.regexp_extract_all(a, F.lit(r"\S+"), F.lit(0))) >= 5).otherwise(aligned)
    cited = F.size(F.regexp_extract_all(a, F.lit(r"\[Source\s+\d+[^\]]*\]"), F.lit(0))).cast("long")
    valid = F.size(F.filter(F.sequence(F.lit(1), F.lit(sources)), lambda i: F.contains(a, F.concat(F.lit("[Source "), i.cast("string"))))).cast("long")
    return answers.select(
        "qid", relevance.alias("concept_relevance_percent"), aligned.alias("evidence_intent_aligned"), cited.alias("citation_count"), valid.alias("valid_citations"), (cited > 0).alias("has_citations"), (low.contains("cannot answer") | low.contains("insufficient")).alias("abstained")
    )


def markdown(best: DataFrame, hits: DataFrame, images: DataFrame) -> DataFrame:
    """qid, markdown: summary bullets of the best sentences and a line for each hit with page, score, preview and images.

    ``best``: qid, n, id, sentence; ``hits``: qid, question, id, rank, score, page, text; ``images``: page, path (two a page).
    """
    w = Window.partitionBy("page").orderBy("path")
    two = images.where("path is not null").select("page", "path").distinct().withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("page").agg(F.array_join(F.array_sort(F.collect_list("path")), ", ").alias("paths"))
    h = hits.join(two, "page", "left")
    line = F.concat(F.format_string("- [%d] %s p. %s (%.4f): ", "rank", "id", F.coalesce(F.col("page").cast("string"), F.lit("?")), "score"), F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 480), F.coalesce(F.concat(F.lit(" ["), "paths", F.lit("]")), F.lit("")))
    lines = h.groupBy("qid").agg(F.max("question").alias("question"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))), lambda x: x["t"]), "\n").alias("evidence"))
    points = best.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("- "), "sentence").alias("t")))), lambda x: x["t"]), "\n").alias("points"))
    return lines.join(points, "qid", "left").select("qid", F.concat(F.lit("# "), "question", F.lit("\n\n"), F.coalesce("points", F.lit("- (none)")), F.lit("\n\n## Evidence\n\n"), "evidence").alias("markdown"))
