"""Queries on questions: understanding, evidence, gates, answers, and the whole chain for a batch of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import answering, gating, lexical, understanding
from ..runtime import cut, read
from . import ask as chain
from .building import edge_table
from .registry import query
from .tables import SQL_EVERY, SQL_NODES, SQL_QUESTIONS, SQL_WORDS, every_question, longs, nodes, questions


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_any(t: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, {_quote(n)})" for n in needles) + ")"


def _re2(pattern: str) -> str:
    """Blanks and digits of a pattern as both engines read them."""
    return _quote(pattern)


_INTENT = (
    "CASE "
    + " ".join(f"WHEN regexp_matches(q, {_re2(p)}) THEN '{k}'" for k, p in L.INTENT_PATTERNS)
    + " WHEN "
    + " OR ".join(f"regexp_matches(q, {_re2(p)})" for p in L.HEADING_PATTERNS)
    + " THEN 'procedure' ELSE 'fact_lookup' END"
)


def _sql_phrase() -> str:
    out = []
    for _, p in L.INTENT_PATTERNS:
        n = p.count("(.+?)")
        groups = ", ".join(f"nullif(trim(regexp_extract(q, {_re2(p)}, {i})), '')" for i in range(1, n + 1))
        out.append(f"WHEN regexp_matches(q, {_re2(p)}) THEN coalesce(nullif(concat_ws(' ', {groups}), ''), q)")
    return "CASE " + " ".join(out) + " ELSE q END"


@query(f"WITH {SQL_EVERY}, a AS (SELECT qid, trim(lower(question)) AS q FROM questions) SELECT qid, {_INTENT} AS intent, {_sql_phrase()} AS concept_phrase FROM a")
def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intents of the sample questions and of all logged ones."""
    name, phrase = understanding.intent(F.col("question"))
    return every_question(spark, sf_dir).select("qid", name.alias("intent"), phrase.alias("concept_phrase"))


_STOP = "[" + ", ".join(map(_quote, L.INTENT_STOPWORDS)) + "]"
_SHORT = "[" + ", ".join(map(_quote, L.SHORT_TERMS)) + "]"
_CONCEPTS = rf"""u AS (SELECT qid, question, q, {_INTENT} AS intent, {_sql_phrase()} AS concept_phrase FROM (SELECT *, trim(lower(question)) AS q FROM questions)),
tk AS (SELECT *, list_filter(regexp_extract_all(lower(concept_phrase), '[\p{{L}}\p{{N}}_]+'), lambda x: NOT list_contains({_STOP}, x)) AS t FROM u),
cc AS (SELECT qid, question, q, intent, concept_phrase, (flatten(list_transform(range(1, greatest(len(t), 1)), lambda i: CASE WHEN i + 2 <= len(t) THEN [t[i] || ' ' || t[i + 1], t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]] ELSE [t[i] || ' ' || t[i + 1]] END))
  || list_filter(t, lambda x: length(x) > 3 OR list_contains({_SHORT}, x)))[:10] AS core_concepts, list_filter([{', '.join(map(_quote, L.ENTITIES))}], lambda e: contains(q, e)) AS entities FROM tk)"""


@query(f"WITH {SQL_EVERY}, {_CONCEPTS} SELECT qid, intent, concept_phrase, array_to_string(core_concepts, '; ') AS core_concepts, array_to_string(entities, '; ') AS entities FROM cc")
def core_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent, phrase, concepts and entities of the sample questions and of all logged ones."""
    u = understanding.understand(every_question(spark, sf_dir))
    return u.select("qid", "intent", "concept_phrase", F.array_join("core_concepts", "; ").alias("core_concepts"), F.array_join("entities", "; ").alias("entities"))


_ENTITIES = "[" + ", ".join(map(_quote, L.ENTITIES)) + "]"


@query(f"SELECT answer_id, e AS entity FROM (SELECT answer_id, unnest(list_filter({_ENTITIES}, lambda x: contains(lower(question), x))) AS e FROM answer WHERE question IS NOT NULL)")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known entities of all logged questions."""
    return read(spark, sf_dir, "answer").where("question is not null").select("answer_id", F.explode(understanding.entities(F.col("question"))).alias("entity"))


_ALIASES = ", ".join(f"({_quote(k)}, [{', '.join(map(_quote, v))}])" for k, v in L.ALIASES.items())


@query(
    f"""WITH {SQL_EVERY}, {_CONCEPTS}, al(key, aliases) AS (VALUES {_ALIASES}), c AS (SELECT qid, lower(question) AS q, unnest(core_concepts) AS concept FROM cc),
v AS (SELECT DISTINCT qid, q, left(q, strpos(q, concept) - 1) || alias || substring(q, strpos(q, concept) + length(concept)) AS query FROM (SELECT qid, q, concept, unnest(aliases) AS alias FROM c JOIN al ON contains(concept, key) OR len(list_filter(aliases, lambda a: contains(concept, a))) > 0 WHERE contains(q, concept))),
x AS (SELECT qid, lower(question) AS query, 0 AS later FROM questions UNION ALL SELECT qid, query, 1 FROM v WHERE query <> q)
SELECT qid, query, row_number() OVER (PARTITION BY qid ORDER BY later, query) AS variant FROM x QUALIFY variant <= 10"""
)
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of the sample questions and of all logged ones."""
    return longs(understanding.expansions(understanding.understand(every_question(spark, sf_dir))))


_TERMS = ["bsl-2", "bsl2", "containment level 2", "biosafety level 2", "bsl iii", "biosafety level", "biosafety level 2 laboratory", "level 2", "level", "autoclave", " BSL ", "the"]
_FAMILY = "(contains(t, 'biosafety level') OR contains(t, 'bsl') OR contains(t, 'containment level'))"
_NUMBER = r"coalesce(nullif(regexp_extract(t, '[\s-](\d+|ii|iii|iv|i)$', 1), ''), CASE WHEN regexp_matches(t, '^(level|bsl|containment level)[\s-]?(\d+|ii|iii|iv|i)$') THEN nullif(regexp_extract(t, '(\d+|ii|iii|iv|i)$', 1), '') END)"


@query(
    f"""WITH v AS (SELECT term, trim(lower(term)) AS t FROM (VALUES {', '.join(f'({_quote(x)})' for x in _TERMS)}) x(term)), n AS (SELECT term, t, {_FAMILY} AS family, {_NUMBER} AS num FROM v),
c AS (SELECT *, CASE WHEN t IN ({', '.join(map(_quote, L.CONCEPT_STOPWORDS))}) THEN NULL WHEN family AND num IS NOT NULL THEN 'biosafety level ' || num WHEN family THEN 'biosafety level' ELSE t END AS canonical FROM n)
SELECT term, canonical, CASE WHEN canonical IS NULL THEN '' WHEN family AND num IS NOT NULL THEN array_to_string(list_sort(['biosafety level-' || num, 'bsl-' || num, 'bsl ' || num, 'bsl' || num, 'containment level ' || num, 'containment level-' || num, 'level ' || num]), '; ')
  WHEN family THEN 'bsl; containment level' ELSE '' END AS aliases FROM c"""
)
def concept_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, aliases = understanding.canonical(F.col("term"))
    return spark.createDataFrame([(t,) for t in _TERMS], "term string").coalesce(1).select("term", name.alias("canonical"), F.array_join(aliases, "; ").alias("aliases"))


def _sql_role(t: str) -> str:
    count = lambda c: f"(length({t}) - length(replace({t}, {c}, '')))"
    low = f"lower({t})"
    return (
        f"CASE WHEN {_sql_any(low, L.DEFINITIONAL)} OR regexp_matches({low}, '\\blevel\\s+\\d+\\s+laborator') THEN 'definition' WHEN {_sql_any(low, L.ROLE_PROCEDURE)} THEN 'procedure' "
        f"WHEN {count('chr(9)')} > 3 OR {count(_quote('|'))} > 3 OR ({count(_quote('-'))} > 10 AND {count('chr(10)')} > 5) THEN 'table' WHEN {_sql_any(low, L.ROLE_EXAMPLE)} THEN 'example' ELSE 'general' END"
    )


@query(f"SELECT doc_id, {_sql_role('text')} AS role FROM documents WHERE text IS NOT NULL")
def content_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.content_role(F.col("text")).alias("role"))


def _validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question with what its concepts found among the text nodes."""
    u = cut(understanding.understand(questions(spark, sf_dir)), "understood")
    return u.join(understanding.validate(u, nodes(spark, sf_dir).select("id", "page", "text")), "qid")


def _sql_grams(n: int) -> str:
    return f"list_transform(range(1, greatest(len(t) - {n - 2}, 1)), lambda i: " + " || ' ' || ".join(f"t[i + {k}]" if k else "t[i]" for k in range(n)) + ")"


_CANONICAL = f"CASE WHEN t IN ({', '.join(map(_quote, L.CONCEPT_STOPWORDS))}) THEN NULL WHEN family AND num IS NOT NULL THEN 'biosafety level ' || num WHEN family THEN 'biosafety level' ELSE t END"
_VAL = rf"""terms AS (SELECT DISTINCT qid, trim(lower(term)) AS t FROM (SELECT qid, unnest(core_concepts || entities) AS term FROM cc)), cn AS (SELECT qid, t, {_FAMILY} AS family, {_NUMBER} AS num FROM terms), cx AS (SELECT *, {_CANONICAL} AS canonical FROM cn),
ax AS (SELECT qid, canonical, canonical AS p, 1 AS tier FROM cx WHERE canonical IS NOT NULL UNION ALL SELECT qid, canonical, unnest(CASE WHEN family AND num IS NOT NULL THEN ['biosafety level ' || num, 'bsl ' || num, 'bsl' || num, 'containment level ' || num, 'level ' || num] WHEN family THEN ['bsl', 'containment level'] ELSE []::VARCHAR[] END), 2 FROM cx WHERE canonical IS NOT NULL),
ph AS (SELECT * FROM (SELECT DISTINCT qid, canonical, p, tier FROM ax) QUALIFY row_number() OVER (PARTITION BY qid, tier ORDER BY len(string_split(p, ' ')) DESC, p) <= 30), pz AS (SELECT * FROM ph UNION ALL SELECT qid, 'biosafety', 'biosafety', 3 FROM cc WHERE len(core_concepts || entities) > 0),
tg AS (SELECT id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s-]+', ' ' || chr(1) || ' ', 'g'), '[\s-]+'), lambda x: x <> '') AS t FROM nodes), gr AS (SELECT DISTINCT id, p FROM (SELECT id, unnest(t || {_sql_grams(2)} || {_sql_grams(3)}) AS p FROM tg) WHERE p IN (SELECT p FROM pz)),
hit AS (SELECT qid, tier, canonical, id FROM gr JOIN pz USING (p)), best AS (SELECT qid, min(tier) AS tier FROM hit GROUP BY qid), ids AS (SELECT * FROM (SELECT DISTINCT qid, tier, id FROM hit JOIN best USING (qid, tier)) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY id) <= 200),
val AS (SELECT qid, tier, list_sort(list_distinct(list(canonical))) AS matched, list_sort(list_distinct(list(id))) AS text_ids, list_sort(list_distinct(list(page) FILTER (page IS NOT NULL))) AS pages, list_sort(list_distinct(list(role))) AS roles FROM ids JOIN hit USING (qid, tier, id) JOIN (SELECT id, page, {_sql_role('text')} AS role FROM nodes) USING (id) GROUP BY ALL),
judged AS (SELECT cc.*, tier IS NOT NULL AS found, CASE tier WHEN 1 THEN 'phrase' WHEN 2 THEN 'alias' WHEN 3 THEN 'section' ELSE 'none' END AS match_quality, coalesce(tier > 1, false) AS fallback_triggered, matched, text_ids, pages, roles FROM cc LEFT JOIN val USING (qid))"""


@query(
    f"""WITH {SQL_QUESTIONS}, {SQL_NODES}, {_CONCEPTS}, {_VAL} SELECT qid, found, coalesce(array_to_string(matched, ' '), '') AS matched_concepts, coalesce(array_to_string(text_ids, ' '), '') AS text_ids, coalesce(array_to_string(pages, ' '), '') AS pages,
coalesce(array_to_string(roles, ' '), '') AS roles, match_quality, fallback_triggered FROM judged"""
)
def concept_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each question's concepts held against the text nodes, in three tiers; lists joined, as they are long."""
    lists = ("matched_concepts", "text_ids", "pages", "roles")
    v = _validated(spark, sf_dir).withColumns({c: F.array_join(F.col(c).cast("array<string>"), " ") for c in lists})
    return v.select("qid", "found", *lists, "match_quality", "fallback_triggered")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 12 text nodes that cover each question best."""
    u, n = cut(understanding.understand(questions(spark, sf_dir)), "understood"), nodes(spark, sf_dir).select("id", "page", "text")
    hits = lexical.coverage_topk(n, u.select("qid", F.col("question").alias("text")), 12).select("qid", "id", "rank")
    return hits.join(n, "id").join(u, "qid").select("qid", "question", "intent", "core_concepts", "entities", "id", "page", "text", "rank")


_EV = f"""{SQL_QUESTIONS}, {SQL_NODES}, {_CONCEPTS}, qw AS (SELECT qid, len(w) AS n, unnest(w) AS term FROM (SELECT qid, {SQL_WORDS.replace('text', 'question')} AS w FROM questions)), dw AS (SELECT id, unnest({SQL_WORDS}) AS term FROM nodes),
cover AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(count(*) / max(n), 6) DESC, id) AS rank FROM dw JOIN qw USING (term) GROUP BY qid, id QUALIFY rank <= 12),
ev AS (SELECT qid, question, q, intent, core_concepts, entities, id, page, text, lower(text) AS t, rank FROM cover JOIN nodes USING (id) JOIN cc USING (qid))"""


def _sql_fit() -> str:
    out = []
    for k, (needles, pattern, _) in L.EVIDENCE.items():
        parts = ([_sql_any("t", needles)] if needles else []) + ([f"regexp_matches(t, {_re2(pattern)})"] if pattern else [])
        out.append(f"WHEN intent = '{k}' THEN {' OR '.join(parts)}")
    return "CASE " + " ".join(out) + " ELSE true END"


_REASON = "CASE " + " ".join(f"WHEN intent = '{k}' THEN CASE WHEN matches THEN '' ELSE 'missing ' END || '{r}'" for k, (_, _, r) in L.EVIDENCE.items()) + " ELSE 'intent not restricted' END"
_FIT = f"{_EV}, fit AS (SELECT *, {_sql_fit()} AS matches FROM ev)"


@query(f"WITH {_FIT} SELECT qid, id, matches, {_REASON} AS reason FROM fit")
def evidence_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gating.with_evidence(_evidence(spark, sf_dir)).select("qid", "id", "matches", "reason")


_SECTION = f"CASE WHEN {_sql_any('q', ['biosafety', 'bsl', 'containment'])} THEN 'biosafety' WHEN {_sql_any('q', ['ppe', 'protective equipment'])} THEN 'ppe' END"
_IN_SECTION = " ".join(f"WHEN {_SECTION} = '{k}' THEN coalesce(page BETWEEN {a} AND {b}, false) OR {_sql_any('t', ws)}" for k, (a, b, ws, _) in L.SECTIONS.items())


@query(f"WITH {_EV}, k AS (SELECT qid, id, rank, CASE {_IN_SECTION} ELSE true END AS keep FROM ev) SELECT qid, id, rank FROM k QUALIFY keep OR NOT bool_or(keep) OVER (PARTITION BY qid)")
def section_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(gating.section_filter(_evidence(spark, sf_dir)).select("qid", "id", "rank"))


_HITS = lambda ws: " + ".join(f"CAST(contains(t, {_quote(w)}) AS INT)" for w in ws) or "0"
_RULE = " ".join(f"WHEN {_sql_any('lower(question)', trig)} THEN ({_HITS(req)}) >= 1 OR ({_HITS(exc)}) <= 1" for trig, req, exc in L.SEMANTIC_RULES.values())


@query(f"WITH {_EV} SELECT qid, id, rank FROM ev WHERE CASE {_RULE} ELSE true END")
def rule_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(gating.rule_filter(_evidence(spark, sf_dir)).select("qid", "id", "rank"))


def _sql_expanded(t: str) -> str:
    pairs = [(k, sorted({p for v in vs for p in v.replace("-", " ").split() if len(p) > 2})) for k, vs in L.SYNONYMS.items()]
    more = " ".join(f"WHEN {_quote(k)} THEN [{', '.join(map(_quote, v))}]" for k, v in pairs)
    w = f"list_filter(regexp_extract_all(lower({t}), '[a-z0-9]+'), lambda x: length(x) > 2)"
    return f"list_distinct({w} || flatten(list_transform({w}, lambda x: CASE x {more} ELSE []::VARCHAR[] END)))"


def _sql_score(concept: str, target: str) -> str:
    return f"(CASE WHEN len({_sql_expanded(concept)}) = 0 THEN 0.0 ELSE len(list_intersect({_sql_expanded(concept)}, {target})) / len({_sql_expanded(concept)}) END)"


_AFTER = "CASE " + " ".join(f"WHEN contains(q, {_quote(p)}) THEN substring(q0, strpos(q0, {_quote(p)}) + {len(p)})" for p in L.QUESTION_PREFIXES) + " ELSE '' END"
_SUBJECT = f"array_to_string(list_filter(regexp_extract_all({_AFTER}, '[a-z0-9]+'), lambda x: length(x) > 2 AND NOT list_contains([{', '.join(map(_quote, L.FILTER_STOPWORDS))}], x)), ' ')"


@query(
    f"""WITH {_EV}, s AS (SELECT qid, id, rank, core_concepts, entities, {_sql_expanded('text')} AS tx, {_sql_expanded(_SUBJECT)} AS c FROM (SELECT *, lower(question) AS q0 FROM ev)),
k AS (SELECT *, len(c) = 0 OR len(list_intersect(tx, c)) >= greatest(1, len(c) // 2) AS keep FROM s), f AS (SELECT * FROM k QUALIFY keep OR NOT bool_or(keep) OVER (PARTITION BY qid)),
h AS (SELECT qid, id, rank, len(core_concepts) = 0 OR len(list_filter(core_concepts || entities, lambda z: {_sql_score('z', 'tx')} >= 0.5)) > 0 AS keep FROM f)
SELECT qid, id, rank FROM h QUALIFY keep OR NOT bool_or(keep) OVER (PARTITION BY qid)"""
)
def concept_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concept filter without a graph, and the constraint on core concepts."""
    return longs(gating.hard_concepts(gating.concept_filter(_evidence(spark, sf_dir))).select("qid", "id", "rank"))


@query(None)
def semantic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All filters in their order, with neighbours in the graph."""
    from ..operators import graph

    ev = _evidence(spark, sf_dir)
    return longs(gating.semantic_filter(ev, graph.neighbors(edge_table(spark, sf_dir), ev.select("id"), 30)).select("qid", "id", "rank"))


@query(
    f"""WITH {_FIT}, {_VAL}, a AS (SELECT qid, count(*) AS n, avg(len(regexp_extract_all(text, '\\S+'))) AS words, count(*) FILTER (matches) AS fit FROM fit GROUP BY qid),
r AS (SELECT qid, CASE WHEN NOT found THEN 'Concepts not found in knowledge base. Cannot answer without source validation.' WHEN match_quality = 'weak' AND intent IN ('definition', 'procedure', 'comparison') THEN 'Only partial concept match. Cannot reliably provide ' || intent || '. Abstaining.'
  WHEN coalesce(n, 0) = 0 THEN 'No content found after retrieval and filtering.' WHEN words < 50 THEN 'Content too brief to answer reliably.' WHEN fit = 0 THEN 'No ' || intent || ' evidence found. Cannot answer without proper source material.' END AS reason FROM judged LEFT JOIN a USING (qid))
SELECT qid, reason IS NOT NULL AS abstained, coalesce(reason, '') AS reason FROM r"""
)
def abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gating.abstention(_validated(spark, sf_dir), gating.with_evidence(_evidence(spark, sf_dir)))


@query(
    f"""WITH {_FIT}, x AS (SELECT qid, count(*) AS n, string_agg(t, chr(10) ORDER BY rank, id) FILTER (matches) AS t FROM fit GROUP BY qid),
g AS (SELECT qid, intent, core_concepts, n, t, list_distinct(flatten(list_transform(core_concepts, lambda c: string_split(c, ' ')))) AS pool, list_filter(core_concepts, lambda c: contains(c, ' ')) AS phrases FROM cc LEFT JOIN x USING (qid)),
f AS (SELECT qid, CASE WHEN n IS NULL THEN 'no_chunks_after_retrieval' WHEN t IS NULL THEN 'no_intent_aligned_evidence' WHEN intent = 'definition' AND len(pool) > 0 AND len(list_filter(pool, lambda w: contains(t, w))) / len(pool) < 0.6 THEN 'insufficient_concept_coverage'
  WHEN intent = 'definition' AND len(phrases) > 0 AND len(list_filter(phrases, lambda c: contains(t, c))) = 0 THEN 'no_complete_concept_match' END AS failure FROM g)
SELECT qid, failure IS NULL AS passed, coalesce(failure, '') AS failure FROM f"""
)
def final_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gating.final_gates(understanding.understand(questions(spark, sf_dir)), gating.with_evidence(_evidence(spark, sf_dir)))


_WIDE = "list_filter(list_filter(core_concepts, lambda c, i: list_position(core_concepts, c) = i), lambda c: contains(c, ' ') OR length(c) > 5)[:5]"


@query(
    f"""WITH {_FIT}, {_VAL}, d AS (SELECT qid, text FROM fit WHERE matches AND intent = 'definition' QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank, id) <= 10), tok AS (SELECT qid, {_sql_expanded('t')} AS tk FROM (SELECT qid, string_agg(text, chr(10)) AS t FROM d GROUP BY qid)),
x AS (SELECT qid, tk, CASE WHEN fallback_triggered THEN 0.4 ELSE 0.6 END AS bound, {_WIDE} AS wide FROM judged LEFT JOIN tok USING (qid) WHERE intent = 'definition'),
y AS (SELECT qid, tk, bound, CAST(CASE WHEN tk IS NULL THEN 0 ELSE round(len(list_filter(wide, lambda z: {_sql_score('z', 'tk')} >= 0.6)) / greatest(1, len(wide)), 6) END AS DOUBLE) AS share FROM x)
SELECT qid, share, tk IS NULL OR share < bound AS locked, CASE WHEN tk IS NULL THEN 'No definition evidence found in retrieved documents.' WHEN share < bound THEN 'Definition evidence does not cover the concepts.' ELSE '' END AS reason FROM y"""
)
def definition_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gating.definition_lock(_validated(spark, sf_dir), gating.with_evidence(_evidence(spark, sf_dir)))


@query(None)
def pass2_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the expanded questions on the pages that validation found."""
    u, n = _validated(spark, sf_dir), nodes(spark, sf_dir).select("id", "page", "text")
    v = understanding.expansions(u)
    key = F.concat_ws(":", "qid", "variant")
    found = lexical.coverage_topk(n, v.where("variant <= 5").select(key.alias("qid"), F.col("query").alias("text")), 20).select(F.split("qid", ":")[0].cast("long").alias("qid"), F.split("qid", ":")[1].cast("int").alias("variant"), "id", "rank").join(n.select("id", "page"), "id")
    return longs(gating.pass2(v.select("qid", "variant"), found, u.select("qid", F.explode("pages").alias("page"))))


_IND = "[" + ", ".join(f"CASE WHEN regexp_matches(lower(text), {_re2(p)}) THEN '{k}' END" for k, p in L.INDICATORS.items()) + "]"


@query(f"SELECT doc_id, array_to_string(f, ' ') AS indicators, CAST(len(f) AS BIGINT) AS n, round(len(f) / 12, 6) AS score FROM (SELECT doc_id, list_filter({_IND}, lambda x: x IS NOT NULL) AS f FROM documents WHERE text IS NOT NULL)")
def definition_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.indicators(F.col("text")).alias("f"))
    return d.select("doc_id", F.array_join("f", " ").alias("indicators"), F.size("f").cast("long").alias("n"), F.round(F.size("f") / 12, 6).alias("score"))


@query(None)
def bundle_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the bundles of each question's evidence."""
    return longs(answering.bundle_scores(answering.bundles(_evidence(spark, sf_dir))))


@query(None)
def bundle_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bundles as places of texts."""
    return longs(answering.flatten(answering.bundles(_evidence(spark, sf_dir))))


_STORE = "[" + ", ".join(map(_quote, L.STORAGE_WORDS)) + "]"
_PARTS = f"""parts AS (SELECT qid, place, trim(s) AS s, pos FROM (SELECT qid, rank AS place, unnest(p) AS s, generate_subscripts(p, 1) AS pos FROM (SELECT qid, rank, string_split_regex(text, '[.!?]+\\s+') AS p FROM ev)) WHERE length(trim(s)) > 10),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place, pos) AS n FROM parts WHERE len(list_intersect(list_filter(regexp_extract_all(lower(s), '[a-z0-9]+'), lambda x: length(x) > 2), {_STORE})) > 0 QUALIFY n <= 3),
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY place, pos) AS n FROM parts WHERE place = 1 QUALIFY n <= 2),
ans AS (SELECT ev.qid, ev.intent, ev.core_concepts, coalesce((SELECT string_agg(s || '.', ' ' ORDER BY n) FROM k WHERE k.qid = ev.qid), (SELECT string_agg(s || '.', ' ' ORDER BY n) FROM f WHERE f.qid = ev.qid), left(ev.text, 300)) AS answer FROM ev WHERE rank = 1)"""


@query(f"WITH {_EV}, {_PARTS} SELECT qid, answer FROM ans")
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.extractive(_evidence(spark, sf_dir).withColumnRenamed("rank", "place"))


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    ctx = _evidence(spark, sf_dir).withColumnRenamed("rank", "place")
    u = understanding.understand(questions(spark, sf_dir)).select("qid", "intent", "core_concepts")
    return u.join(answering.extractive(ctx), "qid"), ctx


_W3 = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: length(x) > 2))"
_DEFINES = _quote("(?i)" + L.DEFINING_VERBS)


@query(
    f"""WITH {_EV}, {_PARTS}, w AS (SELECT qid, list_distinct(flatten(list({_W3.replace('{0}', 'text')}))) AS w FROM ev WHERE rank <= 5 GROUP BY qid),
s AS (SELECT qid, intent, answer, CASE WHEN len({_W3.replace('{0}', 'answer')}) = 0 THEN 0.0 ELSE len(list_intersect({_W3.replace('{0}', 'answer')}, w)) / len({_W3.replace('{0}', 'answer')}) END AS c FROM ans LEFT JOIN w USING (qid)),
b AS (SELECT *, CASE WHEN len(regexp_extract_all(answer, '\\S+')) >= 5 THEN least(1.0, c + 0.2) ELSE c END AS d FROM s),
x AS (SELECT *, CASE WHEN intent = 'definition' AND NOT regexp_matches(answer, {_DEFINES}) THEN greatest(0.0, d - 0.3) ELSE d END AS e FROM b)
SELECT qid, CASE WHEN e < 0.3 AND NOT contains(lower(answer), 'don''t') THEN 'Insufficient confidence in answer. Retrieved context may not contain accurate information.' ELSE answer END AS answer,
  CAST(round(CASE WHEN e < 0.3 AND NOT contains(lower(answer), 'don''t') THEN 0.2 ELSE e END, 6) AS DOUBLE) AS confidence FROM x"""
)
def answer_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.confidence(*_answers(spark, sf_dir))


_METRICS = " ".join(f"WHEN intent = '{k}' THEN regexp_matches(answer, {_quote(p)})" for k, p in answering._ALIGNED.items())


@query(
    f"""WITH {_EV}, {_PARTS} SELECT qid, CASE WHEN len(core_concepts) = 0 THEN 0.0::DOUBLE ELSE round(100.0 * len(list_filter(core_concepts, lambda c: contains(lower(answer), c))) / len(core_concepts), 1)::DOUBLE END AS concept_relevance_percent,
CASE {_METRICS} ELSE len(regexp_extract_all(answer, '\\S+')) >= 5 END AS evidence_intent_aligned, len(regexp_extract_all(answer, '\\[Source\\s+\\d+[^\\]]*\\]')) AS citation_count,
len(list_filter(range(1, 11), lambda i: contains(answer, '[Source ' || i))) AS valid_citations, len(regexp_extract_all(answer, '\\[Source\\s+\\d+[^\\]]*\\]')) > 0 AS has_citations, contains(lower(answer), 'cannot answer') OR contains(lower(answer), 'insufficient') AS abstained FROM ans"""
)
def answer_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.metrics(_answers(spark, sf_dir)[0])


@query(None)
def markdown_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited answers as Markdown, with the images of the pages."""
    ev = _evidence(spark, sf_dir).where("rank <= 5")
    hits = ev.withColumn("score", F.round(T.coverage(F.col("question"), F.col("text")), 6))
    return answering.markdown(lexical.best_sentences(ev), hits, read(spark, sf_dir, "nodes_image").select(F.col("page").cast("long").alias("page"), "path"))


@query(
    f"""WITH {_EV} SELECT qid, string_agg('[Text ' || rank || '] (ID: ' || id || ', Page: ' || coalesce(CAST(page AS VARCHAR), '?') || '):' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10) || 'Question: ' || any_value(question) AS prompt FROM ev WHERE rank <= 5 GROUP BY qid"""
)
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt for each question, of its five best texts."""
    return answering.prompt(_evidence(spark, sf_dir).where("rank <= 5").withColumnRenamed("rank", "place"))


@query(None)
def ask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain for the sample questions and the stated queries; nested columns as JSON."""
    i = read(spark, sf_dir, "nodes_image").where("img_id is not null").groupBy("img_id").agg(F.max("path").alias("path"), F.max("page").alias("page"))
    e = read(spark, sf_dir, "rel_text_image").where("chunk_id is not null and img_id is not null").select("chunk_id", "img_id", "score")
    out = chain.ask(questions(spark, sf_dir), nodes(spark, sf_dir).select("id", "page", "text"), edge_table(spark, sf_dir), i, e)
    return out.withColumns({c: F.to_json(c) for c, t in out.dtypes if t.startswith(("struct", "array"))})
