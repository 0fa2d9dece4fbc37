"""Questions: intent, concepts, entities, expansions, canonical concepts and their validation against texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..runtime import broadcast_if_small, cut


def intent(q: Column) -> tuple[Column, Column]:
    """(intent, captured phrase): the first pattern that fits, then procedure headings, else fact_lookup.

    The phrase joins the pattern's groups; without a pattern it is the whole question.
    """
    low = F.trim(F.lower(q))
    name, phrase = F.when(_heading(low), "procedure").otherwise("fact_lookup"), low
    for kind, pattern in reversed(L.INTENT_PATTERNS):
        groups = [F.trim(F.regexp_extract(low, pattern, i)) for i in range(1, 1 + pattern.count("(.+?)"))]
        whole = F.array_join(F.filter(F.array(*groups), lambda x: x != ""), " ")
        fits = low.rlike(pattern)
        name, phrase = F.when(fits, kind).otherwise(name), F.when(fits, F.when(whole == "", low).otherwise(whole)).otherwise(phrase)
    return name, phrase


def _heading(low: Column) -> Column:
    out = F.lit(False)
    for p in L.HEADING_PATTERNS:
        out = out | low.rlike(p)
    return out


def core_concepts(phrase: Column) -> Column:
    """At most 10 phrases: neighbouring pairs and triples of words, then single words; stopwords are skipped, repeats stay."""
    t = F.filter(F.regexp_extract_all(F.lower(phrase), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda x: ~x.isin(L.INTENT_STOPWORDS))
    n = F.size(t)
    none = F.array().cast("array<string>")
    at = F.when(n > 1, F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(at, lambda i: F.when(i + 2 <= n, F.array(F.array_join(F.slice(t, i, 2), " "), F.array_join(F.slice(t, i, 3), " "))).otherwise(F.array(F.array_join(F.slice(t, i, 2), " "))))
    singles = F.filter(t, lambda x: (F.length(x) > 3) | x.isin(L.SHORT_TERMS))
    return F.slice(F.concat(F.coalesce(F.flatten(pairs), none), singles), 1, 10)


def entities(q: Column) -> Column:
    """The known entities that a question contains, in their fixed order."""
    low = F.lower(q)
    return F.filter(F.array(*map(F.lit, L.ENTITIES)), lambda e: F.contains(low, e))


def understand(questions: DataFrame) -> DataFrame:
    """``questions`` (qid, question) with intent, concept_phrase, core_concepts and entities."""
    name, phrase = intent(F.col("question"))
    out = questions.withColumn("intent", name).withColumn("concept_phrase", phrase)
    return out.withColumn("core_concepts", core_concepts(F.col("concept_phrase"))).withColumn("entities", entities(F.col("question")))


def expansions(understood: DataFrame, most: int = 10) -> DataFrame:
    """qid, variant, query: the question and its variants with a concept replaced by an alias, by order of text after the question itself."""
    understood = cut(understood.select("qid", "question", "core_concepts"), "understood")
    low = F.lower("question")
    c = understood.select("qid", low.alias("q"), F.explode("core_concepts").alias("concept"))
    pairs = [F.struct(F.lit(k).alias("key"), F.array(*map(F.lit, v)).alias("aliases")) for k, v in L.ALIASES.items()]
    c = c.withColumn("e", F.explode(F.array(*pairs)))
    fits = F.contains("concept", F.col("e.key")) | F.exists("e.aliases", lambda a: F.contains(F.col("concept"), a))
    v = c.where(fits & F.contains("q", F.col("concept"))).select("qid", "q", "concept", F.explode("e.aliases").alias("alias"))
    at = F.instr(F.col("q"), F.col("concept"))
    new = F.concat(F.substring("q", F.lit(1), at - 1), "alias", F.expr("substring(q, instr(q, concept) + length(concept))"))
    variants = v.select("qid", new.alias("query")).distinct().join(understood.select("qid", low.alias("q")), "qid").where("query <> q").select("qid", "query", F.lit(1).alias("later"))
    own = understood.select("qid", low.alias("query"), F.lit(0).alias("later"))
    w = Window.partitionBy("qid").orderBy("later", "query")
    return own.union(variants).withColumn("variant", F.row_number().over(w)).where(F.col("variant") <= most).select("qid", "variant", "query")


_NUM = r"(\d+|ii|iii|iv|i)$"


def canonical(term: Column) -> tuple[Column, Column]:
    """(canonical form, aliases) of a concept; a stopword has none."""
    t = F.trim(F.lower(term))
    family = F.contains(t, F.lit("biosafety level")) | F.contains(t, F.lit("bsl")) | F.contains(t, F.lit("containment level"))
    spaced = F.regexp_extract(t, r"[\s-]" + _NUM, 1)
    glued = F.when(t.rlike(r"^(level|bsl|containment level)[\s-]?" + _NUM), F.regexp_extract(t, _NUM, 1)).otherwise("")
    num = F.coalesce(F.nullif(spaced, F.lit("")), F.nullif(glued, F.lit("")))
    name = F.when(t.isin(L.CONCEPT_STOPWORDS), None).when(family & num.isNotNull(), F.concat(F.lit("biosafety level "), num)).when(family, "biosafety level").otherwise(t)
    forms = ("biosafety level-", "bsl-", "bsl ", "bsl", "containment level ", "containment level-", "level ")
    none = F.array().cast("array<string>")
    aliases = F.when(family & num.isNotNull(), F.array(*[F.concat(F.lit(x), num) for x in forms])).when(family, F.array(F.lit("bsl"), F.lit("containment level"))).otherwise(none)
    return name, F.when(name.isNull(), none).otherwise(F.array_sort(aliases))


def phrase_words(t: Column) -> Column:
    """The words of a text in order; blanks and hyphens stand between words, other marks are words that no phrase has."""
    return F.filter(F.split(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_\s-]+", " \x01 "), r"[\s-]+"), lambda x: x != "")


def phrase_grams(w: Column, most: int) -> Column:
    """The distinct runs of up to ``most`` of the words."""
    out, last, none = w, w, F.array().cast("array<string>")
    for n in range(2, most + 1):
        last = F.when(F.size(w) >= n, F.zip_with(last, F.slice(w, n, F.greatest(F.size(w) - n + 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(none)
        last = F.filter(last, lambda x: x.isNotNull())
        out = F.concat(out, last)
    return F.array_distinct(out)


def validate(understood: DataFrame, texts: DataFrame, most_patterns: int = 30, most_texts: int = 200) -> DataFrame:
    """qid, found, matched_concepts, text_ids, pages, roles, match_quality, fallback_triggered.

    The texts (id, page, text) that hold a canonical concept as a phrase count; where a question has none, those
    with an alias; then those that mention biosafety; each tier at most ``most_texts``, by id.  A question
    without concepts and entities finds nothing.  Phrases meet the texts by their words, whatever the number of questions.
    """
    understood = cut(understood.select("qid", "core_concepts", "entities"), "understood")
    terms = understood.select("qid", F.explode(F.concat("core_concepts", "entities")).alias("term")).distinct()
    name, aliases = canonical(F.col("term"))
    c = terms.select("qid", name.alias("canonical"), aliases.alias("aliases")).where("canonical is not null")
    phrases = c.select("qid", "canonical", F.col("canonical").alias("p"), F.lit(1).alias("tier")).union(c.select("qid", "canonical", F.explode("aliases").alias("p"), F.lit(2).alias("tier")))
    sections = understood.where(F.size(F.concat("core_concepts", "entities")) > 0).select("qid", F.lit("biosafety").alias("canonical"), F.lit("biosafety").alias("p"), F.lit(3).alias("tier"))
    w = Window.partitionBy("qid", "tier").orderBy(F.desc(F.size(F.split("p", " "))), "p")
    phrases = phrases.withColumn("p", F.replace("p", F.lit("-"), F.lit(" "))).distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= most_patterns).drop("n")
    rows = cut(phrases.union(sections), "phrases")
    longest = rows.agg(F.max(F.size(F.split("p", " ")))).first()[0] or 1
    hit = texts.select("id", "page", T.content_role(F.col("text")).alias("role"), phrase_words(F.col("text")).alias("w"))
    hit = hit.select("id", "page", "role", F.explode(phrase_grams(F.col("w"), longest)).alias("p"))
    hit = hit.join(broadcast_if_small(cut(rows.select("p").distinct(), "wanted")), "p")
    # of a tier's first texts by id each is among the first of every phrase it holds
    hit = hit.withColumn("n", F.row_number().over(Window.partitionBy("p").orderBy("id"))).where(F.col("n") <= most_texts).drop("n")
    per = rows.join(hit, "p").groupBy("qid", "tier", "id", "page", "role").agg(F.collect_set("canonical").alias("canonical"))
    best = per.groupBy("qid").agg(F.min("tier").alias("tier"))
    v = Window.partitionBy("qid").orderBy("id")
    kept = per.join(best, ["qid", "tier"]).withColumn("n", F.row_number().over(v)).where(F.col("n") <= most_texts)
    found = kept.groupBy("qid").agg(
        F.min("tier").alias("tier"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("canonical")))).alias("matched_concepts"), F.array_sort(F.collect_set("id")).alias("text_ids"), F.array_sort(F.collect_set("page")).alias("pages"), F.array_sort(F.collect_set("role")).alias("roles")
    )
    none = lambda t: F.array().cast(f"array<{t}>")
    id_type, page_type = texts.schema["id"].dataType.simpleString(), texts.schema["page"].dataType.simpleString()
    quality = F.when(F.col("tier") == 1, "phrase").when(F.col("tier") == 2, "alias").when(F.col("tier") == 3, "section").otherwise("none")
    return understood.select("qid").join(found, "qid", "left").select(
        "qid", F.col("tier").isNotNull().alias("found"), F.coalesce("matched_concepts", none("string")).alias("matched_concepts"), F.coalesce("text_ids", none(id_type)).alias("text_ids"), F.coalesce("pages", none(page_type)).alias("pages"),
        F.coalesce("roles", none("string")).alias("roles"), quality.alias("match_quality"), F.coalesce(F.col("tier") > 1, F.lit(False)).alias("fallback_triggered"),
    )
