"""Evidence filters and gates.  Evidence is rows (qid, question, intent, core_concepts, entities, id, page, text, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T


def keep_or_all(df: DataFrame, keep: Column) -> DataFrame:
    """The rows of each question that ``keep`` holds for, or all where it holds for none."""
    k = F.coalesce(keep, F.lit(False)).cast("int")
    return df.withColumn("_keep", k).withColumn("_any", F.max("_keep").over(Window.partitionBy("qid"))).where("_keep = 1 or _any = 0").drop("_keep", "_any")


def section(q: Column) -> Column:
    """The section a question belongs to, if any."""
    low = F.lower(q)
    return F.when(T.any_of(low, ["biosafety", "bsl", "containment"]), "biosafety").when(T.any_of(low, ["ppe", "protective equipment"]), "ppe")


def asks_definition(q: Column) -> Column:
    return T.any_of(F.lower(q), L.QUESTION_PREFIXES)


def rule_filter(df: DataFrame) -> DataFrame:
    """Rows with a required concept or at most one excluded one, by the rule that the question triggers."""
    q, t, keep = F.lower("question"), F.lower("text"), F.lit(True)
    for triggers, required, excluded in reversed(list(L.SEMANTIC_RULES.values())):
        keep = F.when(T.any_of(q, triggers), (T.hits(t, required) >= 1) | (T.hits(t, excluded) <= 1)).otherwise(keep)
    return df.where(F.coalesce(keep, F.lit(False)))


def section_filter(df: DataFrame) -> DataFrame:
    """Rows in the pages of the question's section or with its keywords; all if there are none."""
    s, t, keep = section(F.col("question")), F.lower("text"), F.lit(True)
    for name, (low, high, words, _) in L.SECTIONS.items():
        keep = F.when(s == name, F.coalesce(F.col("page").between(low, high), F.lit(False)) | T.any_of(t, words)).otherwise(keep)
    return keep_or_all(df, keep)


def entity_filter(df: DataFrame, neighbours: DataFrame | None = None) -> DataFrame:
    """Rows with a keyword of the question's section in the text, or in the label or id of a neighbour (seed, dst)."""
    s, t, keep = section(F.col("question")), F.lower("text"), F.lit(True)
    near = F.lit("")
    if neighbours is not None:
        n = neighbours.groupBy(F.col("seed").alias("id")).agg(F.concat_ws(" ", F.collect_set(F.lower("dst"))).alias("_near"))
        df = df.join(n, "id", "left")
        near = F.coalesce("_near", F.lit(""))
    for name, (_, _, _, words) in L.SECTIONS.items():
        keep = F.when(s == name, T.any_of(t, words) | T.any_of(near, words)).otherwise(keep)
    return keep_or_all(df, keep).drop("_near")


def concept_filter(df: DataFrame, neighbours: DataFrame | None = None, near: int = 20) -> DataFrame:
    """For definition questions the rows with half of the concept's expanded words, or with one of them in the label or id of
    one of their ``near`` best similar neighbours (seed, dst, rel_type, score); all if there are none."""
    low, after = F.lower("question"), F.lit("")
    for p in reversed(L.QUESTION_PREFIXES):
        after = F.when(low.contains(p), F.expr(f"substring(lower(question), instr(lower(question), '{p}') + {len(p)})")).otherwise(after)
    words = F.array_join(F.filter(T.words3(after), lambda x: ~x.isin(L.FILTER_STOPWORDS)), " ")
    c = T.expanded(words)
    needed = F.greatest(F.lit(1), F.floor(F.size(c) / 2))
    keep = (F.size(c) == 0) | (F.size(F.array_intersect(T.expanded(F.col("text")), c)) >= needed)
    if neighbours is None:
        return keep_or_all(df, keep)
    best = Window.partitionBy("seed").orderBy(F.desc("score"), "dst")
    n = neighbours.where("rel_type = 'SIMILAR_TO'").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= near)
    n = n.groupBy(F.col("seed").alias("id")).agg(T.expanded(F.concat_ws(" ", F.lit("text"), F.collect_set("dst"))).alias("_near"))
    touched = F.coalesce(F.arrays_overlap("_near", c), F.lit(False))
    return keep_or_all(df.join(n, "id", "left"), keep | touched).select(*df.columns)


def hard_concepts(df: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows that match a core concept, else an entity, by half of its expanded words; all if there are none."""
    df = df.withColumn("_t", T.expanded(F.col("text")))
    hit = lambda a: F.exists(a, lambda c: T.match_score(c, F.col("_t")) >= least)
    return keep_or_all(df, (F.size("core_concepts") == 0) | hit(F.col("core_concepts")) | hit(F.col("entities"))).drop("_t")


def semantic_filter(df: DataFrame, neighbours: DataFrame | None = None) -> DataFrame:
    """All filters in their order.  Questions that trigger no rule keep all rows, unless all are index pages or too short."""
    triggered = T.any_of(F.lower("question"), [t for r in L.SEMANTIC_RULES.values() for t in r[0]])
    usable = ~T.looks_like_index(F.col("text")) & (F.size(F.split(F.trim("text"), r"\s+")) >= 15)
    df = df.withColumn("_ok", F.max(usable.cast("int")).over(Window.partitionBy("qid"))).where("_ok = 1").drop("_ok").withColumn("_rule", triggered)
    ruled = hard_concepts(concept_filter(entity_filter(section_filter(rule_filter(df.where("_rule"))), neighbours), neighbours))
    return ruled.select(*df.columns).union(df.where("not _rule")).drop("_rule")


def with_evidence(df: DataFrame) -> DataFrame:
    """Rows with ``matches`` and ``reason``: whether the text holds what the intent asks for."""
    e = T.evidence(F.col("intent"), F.col("text"))
    return df.withColumn("_e", e).withColumn("matches", F.col("_e.ok")).withColumn("reason", F.col("_e.reason")).drop("_e")


def definition_lock(questions: DataFrame, evidence: DataFrame, first: int = 10, least: float = 0.6, lenient: float = 0.4) -> DataFrame:
    """qid, share, locked, reason of every definition question (qid, intent, core_concepts, fallback_triggered).

    ``share``: of its longer concepts (first 5 distinct) those whose expanded words the first ``first`` texts with matching
    evidence hold together by 0.6.  A question is locked without such texts, or with a share below ``least``, which
    is ``lenient`` where validation fell back; one without longer concepts has a share of 0.
    """
    d = evidence.where((F.col("intent") == "definition") & F.col("matches")).withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "id"))).where(F.col("_r") <= first)
    t = d.groupBy("qid").agg(T.expanded(F.concat_ws("\n", F.collect_list("text"))).alias("t"))
    wide = F.slice(F.filter(F.array_distinct("core_concepts"), lambda c: F.contains(c, F.lit(" ")) | (F.length(c) > 5)), 1, 5)
    q = questions.where("intent = 'definition'").select("qid", wide.alias("wide"), F.when(F.coalesce("fallback_triggered", F.lit(False)), lenient).otherwise(least).alias("bound")).join(t, "qid", "left")
    met = F.size(F.filter("wide", lambda c: T.match_score(c, F.col("t")) >= 0.6))
    share = F.when(F.col("t").isNull(), 0.0).otherwise(F.round(met / F.greatest(F.lit(1), F.size("wide")), 6))
    reason = F.when(F.col("t").isNull(), "No definition evidence found in retrieved documents.").when(share < F.col("bound"), "Definition evidence does not cover the concepts.").otherwise("")
    return q.select("qid", share.alias("share"), (reason != "").alias("locked"), reason.alias("reason"))


def abstention(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """qid, abstained, reason: the first rule that forbids an answer.

    ``questions``: qid, intent, found, match_quality; ``evidence``: rows with ``matches``.
    """
    a = evidence.groupBy("qid").agg(F.count("*").alias("n"), F.avg(F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)))).alias("words"), F.count_if("matches").alias("fit"))
    q = questions.select("qid", "intent", "found", "match_quality").join(a, "qid", "left")
    strict = F.col("intent").isin("definition", "procedure", "comparison")
    reason = (
        F.when(~F.col("found"), "Concepts not found in knowledge base. Cannot answer without source validation.")
        .when((F.col("match_quality") == "weak") & strict, F.concat(F.lit("Only partial concept match. Cannot reliably provide "), "intent", F.lit(". Abstaining.")))
        .when(F.coalesce("n", F.lit(0)) == 0, "No content found after retrieval and filtering.")
        .when(F.col("words") < 50, "Content too brief to answer reliably.")
        .when(F.col("fit") == 0, F.concat(F.lit("No "), "intent", F.lit(" evidence found. Cannot answer without proper source material.")))
    )
    return q.select("qid", reason.isNotNull().alias("abstained"), F.coalesce(reason, F.lit("")).alias("reason"))


def final_gates(questions: DataFrame, evidence: DataFrame, least: float = 0.6) -> DataFrame:
    """qid, passed, failure of the last gates: evidence; for definitions also word coverage and one whole phrase."""
    fit = evidence.where("matches")
    text = fit.groupBy("qid").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", F.lower("text").alias("t")))), lambda x: x["t"])).alias("t"))
    seen = evidence.groupBy("qid").agg(F.count("*").alias("n"))
    q = questions.select("qid", "intent", "core_concepts").join(seen, "qid", "left").join(text, "qid", "left")
    pool = F.array_distinct(F.flatten(F.transform("core_concepts", lambda c: F.split(c, " "))))
    share = F.when(F.size(pool) == 0, 1.0).otherwise(F.size(F.filter(pool, lambda w: F.contains(F.col("t"), w))) / F.size(pool))
    phrases = F.filter("core_concepts", lambda c: F.contains(c, F.lit(" ")))
    defines = F.col("intent") == "definition"
    failure = (
        F.when(F.col("n").isNull(), "no_chunks_after_retrieval")
        .when(F.col("t").isNull(), "no_intent_aligned_evidence")
        .when(defines & (share < least), "insufficient_concept_coverage")
        .when(defines & (F.size(phrases) > 0) & ~F.exists(phrases, lambda c: F.contains(F.col("t"), c)), "no_complete_concept_match")
    )
    return q.select("qid", failure.isNull().alias("passed"), F.coalesce(failure, F.lit("")).alias("failure"))


def pass2(variants: DataFrame, found: DataFrame, validated: DataFrame, most_variants: int = 5, per_variant: int = 10, enough: int = 5) -> DataFrame:
    """qid, id, variant, rank: a second search's texts on validated pages, without repeats, from variants until ``enough``.

    ``variants``: qid, variant; ``found``: qid, variant, id, page, rank; ``validated``: qid, page.  A variant is read only
    while those before it gave fewer than ``enough`` texts.
    """
    f = found.join(variants.where(F.col("variant") <= most_variants).select("qid", "variant"), ["qid", "variant"], "left_semi").where(F.col("rank") <= per_variant)
    f = f.join(validated.select("qid", "page").distinct(), ["qid", "page"], "left_semi")
    once = Window.partitionBy("qid", "id").orderBy("variant", "rank")
    f = f.withColumn("o", F.row_number().over(once)).where("o = 1")
    upto = F.coalesce(F.count("*").over(Window.partitionBy("qid").orderBy("variant").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return f.withColumn("before", upto).where(F.col("before") < enough).select("qid", "id", "variant", "rank")
