"""Queries on vectors, lexical search, fusion and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fusion, lexical, vectors
from ..runtime import read
from .registry import query
from .tables import SQL_ASKED, SQL_DOCS, SQL_NODES, SQL_WORDS, asked, docs, longs, nodes, sql_grams

_DENSE = """dense AS (SELECT q.vec_id AS qid, e.vec_id AS id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, e.vec_id) <= {0})"""


def _sql_dense(k: int) -> str:
    return _DENSE.replace("{0}", str(k))


def _dense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return vectors.topk(e, e.where("id % 20 = 0").withColumnRenamed("id", "qid"), k)


@query(f"WITH {_sql_dense(5)} SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM dense")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(_dense(spark, sf_dir, 5))


@query(
    """WITH e AS (SELECT vec_id AS id, embedding, label FROM embeddings), q AS (SELECT * FROM e WHERE id % 20 = 0)
SELECT q.id AS qid, e.id AS id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score,
  row_number() OVER (PARTITION BY q.id ORDER BY score DESC, e.id) AS rank
FROM q JOIN e ON e.label = q.label AND e.id <> q.id QUALIFY rank <= 5"""
)
def allowlist_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 5 among the vectors that share the query's label, which are filtered before the ranking."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    q = e.where("id % 20 = 0").withColumnRenamed("id", "qid")
    allow = q.select("qid", "label").join(e.select("id", "label"), "label").where("id <> qid").select("qid", "id")
    return longs(vectors.topk(e, q, 5, allow=allow))


_COVER = f"""qw AS (SELECT qid, len(w) AS n, unnest(w) AS term FROM (SELECT qid, {SQL_WORDS} AS w FROM asked)), dw AS (SELECT id, unnest({SQL_WORDS}) AS term FROM {{0}}),
cover AS (SELECT qid, id, round(count(*) / max(n), 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM dw JOIN qw USING (term) GROUP BY qid, id QUALIFY rank <= {{1}})"""


def _cover(table: str, k: int) -> str:
    return _COVER.replace("{0}", table).replace("{1}", str(k))


@query(f"WITH {SQL_DOCS}, {SQL_ASKED}, {_cover('docs', 5)} SELECT * FROM cover")
def keyword_coverage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(lexical.coverage_topk(docs(spark, sf_dir), asked(spark, sf_dir), 5))


_VOCAB = f"""counts AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(g) AS term FROM {sql_grams('docs')}) GROUP BY ALL),
vocab AS (SELECT term, sum(tf) AS tf, count(*) AS df, ln((1 + (SELECT count(*) FROM docs)) / (1 + count(*))) + 1 AS idf FROM counts GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {{0}})"""


def _vocab(size: int) -> str:
    return _VOCAB.replace("{0}", str(size))


@query(f"WITH {SQL_DOCS}, {_vocab(2000)} SELECT term, CAST(tf AS BIGINT) AS tf, df FROM vocab")
def tfidf_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 most frequent words and word pairs."""
    return lexical.vocabulary(lexical.term_counts(docs(spark, sf_dir)), 2000).select("term", "tf", "df")


_ROWS = """dw AS (SELECT id, term, counts.tf * idf AS x FROM counts JOIN vocab USING (term)), weights AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM dw)"""


@query(
    f"""WITH {SQL_DOCS}, {SQL_ASKED}, {_vocab(2000)}, {_ROWS},
qc AS (SELECT id AS qid, term, count(*) * any_value(idf) AS x FROM (SELECT id, unnest(g) AS term FROM {sql_grams('(SELECT qid AS id, text FROM asked)')}) JOIN vocab USING (term) GROUP BY ALL),
qw AS (SELECT qid, term, x / sqrt(sum(x * x) OVER (PARTITION BY qid)) AS qw FROM qc)
SELECT qid, id, round(sum(w * qw), 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM weights JOIN qw USING (term) GROUP BY qid, id HAVING score > 0 QUALIFY rank <= 5"""
)
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, vocab = lexical.tfidf(docs(spark, sf_dir), 2000)
    return longs(lexical.search(weights, vocab, asked(spark, sf_dir), 5))


@query(
    f"""WITH {SQL_DOCS}, {_vocab(50000)}, {_ROWS}
SELECT q.id AS src, d.id AS dst, round(sum(d.w * q.w), 4) AS score FROM weights d JOIN weights q USING (term) WHERE q.id % 20 = 0 AND d.id <> q.id GROUP BY q.id, d.id
HAVING round(sum(d.w * q.w), 9) >= 0.25 QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY round(sum(d.w * q.w), 9) DESC, d.id) <= 5"""
)
def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF neighbours of the documents whose id is divisible by 20, among all."""
    d = docs(spark, sf_dir)
    return lexical.knn_edges(d, d.where("id % 20 = 0"))


def _plain_split(t):
    return F.filter(F.transform(F.split(F.regexp_replace(t, r"([.?!…।؟])[ \t\n\r\f]+", "$1\x01"), "\x01"), F.trim), lambda x: F.length(x) > 0)


@query(
    f"""WITH {SQL_DOCS}, {SQL_ASKED}, {_cover('docs', 3)},
s AS (SELECT qid, asked.text AS question, id, rank, unnest(p) AS sentence, generate_subscripts(p, 1) AS pos FROM (
  SELECT qid, id, rank, list_filter(list_transform(string_split(regexp_replace(docs.text, '([.?!…।؟])[ \\t\\n\\r\\f]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 0) AS p FROM cover JOIN docs USING (id)) JOIN asked USING (qid)),
c AS (SELECT *, round(len(list_intersect(qw, sw)) / nullif(len(qw), 0), 6) AS score FROM (SELECT *, {SQL_WORDS.replace('text', 'question')} AS qw, {SQL_WORDS.replace('text', 'sentence')} AS sw FROM s WHERE length(sentence) >= 20) WHERE len(qw) > 0),
f AS (SELECT * FROM c WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY qid, substring(sentence, 1, 160) ORDER BY score DESC, rank, pos) = 1)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank, pos) AS n, id, sentence, score FROM f QUALIFY n <= 6"""
)
def best_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, q = docs(spark, sf_dir), asked(spark, sf_dir)
    hits = lexical.coverage_topk(d, q, 3).join(d, "id").join(q.withColumnRenamed("text", "question"), "qid")
    return longs(lexical.best_sentences(hits, 6, _plain_split))


_CONCEPTS = ["biosafety cabinet", "laboratory ppe", "autoclave cooker", "centrifuge", "level", "of"]


@query(
    """WITH c AS (SELECT unnest(['biosafety cabinet', 'laboratory ppe', 'autoclave cooker', 'centrifuge', 'level', 'of']) AS concept),
syn(word, more) AS (VALUES ('biosafety', ['bsl', 'bio', 'safety']), ('bsl', ['biosafety']), ('level', ['lvl']), ('laboratory', ['lab']), ('lab', ['laboratory']), ('cabinet', ['hood', 'bsc']), ('hood', ['cabinet', 'bsc']),
  ('autoclave', ['steam', 'sterilizer', 'pressure', 'cooker']), ('sterilization', ['decontamination', 'disinfection']), ('ppe', ['protective', 'equipment']), ('respirator', ['mask'])),
base AS (SELECT 'c' || concept AS k, unnest(regexp_extract_all(lower(concept), '[a-z0-9]+')) AS word FROM c UNION ALL SELECT 'd' || doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) FROM documents),
words AS (SELECT DISTINCT k, word FROM base WHERE length(word) > 2), full_ AS (SELECT k, word FROM words UNION SELECT k, unnest(more) FROM words JOIN syn USING (word)),
n AS (SELECT k, count(*) AS n FROM full_ WHERE k[1] = 'c' GROUP BY k),
hit AS (SELECT a.k AS ck, b.k AS dk, count(*) AS hits FROM full_ a JOIN full_ b USING (word) WHERE a.k[1] = 'c' AND b.k[1] = 'd' GROUP BY ALL)
SELECT concept, doc_id, round(coalesce(hits / n, 0), 6) AS score FROM c CROSS JOIN (SELECT doc_id FROM documents WHERE text IS NOT NULL) LEFT JOIN n ON n.k = 'c' || concept LEFT JOIN hit ON ck = 'c' || concept AND dk = 'd' || doc_id
WHERE coalesce(hits / n, 0) > 0"""
)
def concept_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.expanded(F.col("text")).alias("t"))
    s = d.select("doc_id", F.explode(F.array(*map(F.lit, _CONCEPTS))).alias("concept"), "t")
    return s.select("concept", "doc_id", F.round(T.match_score(F.col("concept"), F.col("t")), 6).alias("score")).where("score > 0")


@query(
    """SELECT src_chunk_id AS qid, rel_id AS id, cosine AS score, round(CASE WHEN max(cosine) OVER w = min(cosine) OVER w THEN 1.0 ELSE (cosine - min(cosine) OVER w) / (max(cosine) OVER w - min(cosine) OVER w) END, 6) AS norm
FROM rel_text_text WHERE cosine BETWEEN -1 AND 1 AND src_chunk_id IS NOT NULL WINDOW w AS (PARTITION BY src_chunk_id)"""
)
def minmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "rel_text_text").where("cosine between -1 and 1 and src_chunk_id is not null").select(F.col("src_chunk_id").alias("qid"), F.col("rel_id").alias("id"), F.col("cosine").alias("score"))
    return fusion.minmax(s).withColumn("norm", F.round("norm", 6))


_NORM = "CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END"


@query(
    f"""WITH {_sql_dense(12)}, docs AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), {_vocab(2000)}, {_ROWS},
qw AS (SELECT id AS qid, term, w AS qw FROM weights WHERE id % 20 = 0 AND id IN (SELECT vec_id FROM embeddings)),
lex AS (SELECT qid, id, round(sum(w * qw), 6) AS score FROM weights JOIN qw USING (term) GROUP BY qid, id HAVING score > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 12),
a AS (SELECT qid, id, {_NORM} AS s FROM dense WINDOW w AS (PARTITION BY qid)), b AS (SELECT qid, id, {_NORM} AS b FROM lex WINDOW w AS (PARTITION BY qid)),
f AS (SELECT qid, id, round(0.6 * coalesce(s, 0) + 0.4 * coalesce(b, 0), 6) AS score FROM a FULL JOIN b USING (qid, id))
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f"""
)
def hybrid_dense_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and TF-IDF of the documents of the same number, fused."""
    d = docs(spark, sf_dir)
    weights, vocab = lexical.tfidf(d, 2000)
    e = read(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("id"))
    q = d.join(e, "id", "left_semi").withColumnRenamed("id", "qid")
    return longs(fusion.hybrid(_dense(spark, sf_dir, 12).select("qid", "id", "score"), lexical.search(weights, vocab, q, 12).select("qid", "id", "score")))


@query(
    f"""WITH c AS (SELECT id, coalesce(method, 'unknown') AS method, max(text) AS text FROM who_chunks_semantic WHERE text IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2), {SQL_ASKED},
qw AS (SELECT qid, len(w) AS n, unnest(w) AS term FROM (SELECT qid, {SQL_WORDS} AS w FROM asked)), dw AS (SELECT id, method, unnest({SQL_WORDS}) AS term FROM c),
top AS (SELECT method, qid, id, round(count(*) / max(n), 6) AS score FROM dw JOIN qw USING (term) GROUP BY method, qid, id QUALIFY row_number() OVER (PARTITION BY method, qid ORDER BY score DESC, id) <= 5)
SELECT method, count(*) AS queries, round(avg(m), 6) AS coverage FROM (SELECT method, qid, avg(score) AS m FROM top GROUP BY ALL) GROUP BY method"""
)
def chunking_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over queries of the mean coverage of their top 5 chunks, by chunking method."""
    c = read(spark, sf_dir, "who_chunks_semantic").where("text is not null and id is not null")
    c = c.groupBy("id", F.coalesce("method", F.lit("unknown")).alias("method")).agg(F.max("text").alias("text"))
    top = lexical.coverage_topk(c, asked(spark, sf_dir), 5, by="method").groupBy("method", "qid").agg(F.avg("score").alias("m"))
    return top.groupBy("method").agg(F.count("*").alias("queries"), F.round(F.avg("m"), 6).alias("coverage"))


def _answer_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "answer").select(F.col("answer_id").alias("qid"), F.posexplode("text_ids").alias("pos", "id"))
    return a.where("id is not null").groupBy("qid", "id").agg((F.min("pos") + 1).cast("long").alias("rank"))


SQL_HITS = "hits AS (SELECT qid, id, min(rank) AS rank FROM (SELECT answer_id AS qid, unnest(text_ids) AS id, generate_subscripts(text_ids, 1) AS rank FROM answer) WHERE id IS NOT NULL GROUP BY ALL)"


@query(f"WITH {SQL_HITS}, {SQL_NODES}, t AS (SELECT qid, id, rank, CAST(sum(length(text)) OVER (PARTITION BY qid ORDER BY rank, id) AS BIGINT) AS upto FROM hits JOIN nodes USING (id)) SELECT * FROM t WHERE upto <= 3500")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of logged answers that fit into 3500 characters."""
    return fusion.pack_context(_answer_texts(spark, sf_dir).join(nodes(spark, sf_dir), "id"))


@query(None)
def embedded_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense search with the offline embedder over the text nodes; no SQL, as the embedder hashes words."""
    n = vectors.embed(nodes(spark, sf_dir).select("id", "text"))
    q = vectors.embed(asked(spark, sf_dir))
    return longs(vectors.topk(n, q, 5))


@query(None)
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of the dense search, ordered again by the default scorer, keyword coverage."""
    n, q = nodes(spark, sf_dir).select("id", "text"), asked(spark, sf_dir)
    hits = vectors.topk(vectors.embed(n), vectors.embed(q), 10).select("qid", "id")
    s = hits.join(n, "id").join(q.select("qid", F.col("text").alias("question")), "qid").select("qid", "id", F.round(T.coverage(F.col("question"), F.col("text")), 6).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return longs(s.withColumn("rank", F.row_number().over(w)).where("rank <= 5"))
