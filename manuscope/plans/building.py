"""Queries of the offline build: cleaning, chunking, the graph, images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, cleaning, graph, images, vectors
from ..runtime import read
from .registry import query
from .retrieval import SQL_HITS, _answer_texts
from .tables import SQL_DOCS, SQL_NODES, docs, longs, nodes

_PAGES = f"{SQL_NODES}, pages AS (SELECT manual AS doc, id AS page, regexp_replace(regexp_replace(replace(text, chr(0), ' '), '\\r\\n?', chr(10), 'g'), '(?m)[ \\t\\x0b\\f]+$', '', 'g') AS text FROM nodes WHERE manual IS NOT NULL)"
_LINES = "lines AS (SELECT doc, page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM pages)"
_SPACE = r"[^ \t\n\r\f]+"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where("manual is not null").select(F.col("manual").alias("doc"), F.col("id").alias("page"), T.normalize(F.col("text")).alias("text"))


@query(
    f"""WITH pages AS (SELECT source AS doc, doc_id AS page, regexp_replace(regexp_replace(replace(text, chr(0), ' '), '\\r\\n?', chr(10), 'g'), '(?m)[ \\t\\x0b\\f]+$', '', 'g') AS text FROM documents WHERE source IS NOT NULL AND text IS NOT NULL), {_LINES},
t AS (SELECT doc, page, trim(line) AS line, line_no FROM lines WHERE trim(line) <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY line_no) AS up, row_number() OVER (PARTITION BY doc, page ORDER BY line_no DESC) AS down FROM t),
s AS (SELECT doc, line, count(*) FILTER (up <= 3) AS top, count(*) FILTER (down <= 3) AS bottom FROM r WHERE length(line) >= 3 GROUP BY ALL),
n AS (SELECT doc, greatest(3, floor(0.003 * count(*))) AS least FROM pages GROUP BY doc)
SELECT doc, line, top, bottom FROM s JOIN n USING (doc) WHERE top >= least OR bottom >= least"""
)
def header_footer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that recur at the edges of the pages of one source."""
    d = read(spark, sf_dir, "documents").where("source is not null and text is not null")
    return longs(cleaning.repeated_lines(d.select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), T.normalize(F.col("text")).alias("text")), 0.003))


@query(f"WITH {_PAGES}, {_LINES} SELECT doc, page, line_no, line FROM lines WHERE regexp_matches(trim(line), '^(?i:[0-9]{{1,4}}|[ivxlcdm]{{1,6}}|PART\\s+[IVXLCDM]+\\s+[0-9]+)$')")
def page_number_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(cleaning.page_lines(_pages(spark, sf_dir)).where(T.is_page_number(F.col("line"))))


@query(f"WITH {SQL_NODES} SELECT id, regexp_replace(text, '(?m)^([^\\n]*)-\\n(\\p{{L}}[^\\n]*)$', '\\1\\2', 'g') AS text FROM nodes")
def dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("id", T.dehyphenate(F.col("text")).alias("text"))


@query(f"WITH {SQL_NODES} SELECT id, regexp_replace(regexp_replace(regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t\\n\\r\\f\\x0b]+\\n', chr(10), 'g'), '[ \\t]+', ' ', 'g') AS text FROM nodes")
def squeeze_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("id", T.squeeze(F.col("text")).alias("text"))


@query(
    f"""WITH {SQL_NODES} SELECT id, regexp_replace(regexp_replace(replace(text, chr(0), ' '), '\\r\\n?', chr(10), 'g'), '(?m)[ \\t\\x0b\\f]+$', '', 'g') AS normal,
trim(regexp_replace(replace(text, chr(8204), ' '), '\\s+', ' ', 'g')) AS for_edges, trim(regexp_replace(replace(text, chr(8204), ''), '\\s+', ' ', 'g')) AS for_export FROM nodes"""
)
def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends and the two white-space forms of each node text."""
    t = F.col("text")
    return nodes(spark, sf_dir).select("id", T.normalize(t).alias("normal"), T.norm_edge(t).alias("for_edges"), T.norm_export(t).alias("for_export"))


@query(
    f"""WITH {_PAGES}, {_LINES}, s AS (SELECT doc, page, line_no, trim(line) AS line, lag(trim(line)) OVER (PARTITION BY doc, page ORDER BY line_no) AS prev FROM lines),
p AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev = '' OR line = '' OR regexp_matches(prev, '[.!?:;)\\]}}»]$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc, page ORDER BY line_no) AS para FROM s)
SELECT doc, page, CAST(para AS BIGINT) AS para, string_agg(line, ' ' ORDER BY line_no) AS text FROM p WHERE line <> '' GROUP BY ALL"""
)
def unwrap_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(cleaning.unwrap(cleaning.page_lines(_pages(spark, sf_dir))))


@query(
    f"""WITH {SQL_DOCS} SELECT id AS doc, length(text) AS chars, len(regexp_extract_all(text, '{_SPACE}')) AS words, len(string_split(text, chr(10))) AS lines, array_to_string(string_split(text, chr(10))[:120], chr(10)) AS preview_head FROM docs"""
)
def document_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.stats(docs(spark, sf_dir).withColumnRenamed("id", "doc"))


@query(None)
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cleaning chain over the manuals' node texts; no SQL, as it includes the compatibility normal form."""
    return cleaning.clean_pages(_pages(spark, sf_dir))


@query(None)
def rendered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each manual's pages joined with the page-break marker; one text a manual."""
    return cleaning.render(_pages(spark, sf_dir))


@query(
    rf"""WITH {SQL_DOCS}, t AS (SELECT id, regexp_extract_all(text, '[^ \t\n\r\f]+[ \t\n\r\f]*') AS tok FROM docs), w AS (SELECT id, tok, len(tok) AS n, unnest(range(0, greatest(len(tok) - 15 - 1, 0) + 1, 85)) AS s FROM t WHERE len(tok) > 0)
SELECT id AS doc, s // 85 AS chunk_no, 'baseline_' || CAST(s // 85 AS VARCHAR) AS id, 'baseline' AS method, s AS start_token, least(s + 100, n) AS end_token, least(s + 100, n) - s AS n_tokens, array_to_string(tok[s + 1:least(s + 100, n)], '') AS text FROM w"""
)
def chunk_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 100 tokens that overlap by 15."""
    return longs(chunking.baseline(docs(spark, sf_dir).withColumnRenamed("id", "doc"), 100, 15))


@query(None)
def chunk_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences packed to at most 200 tokens; no SQL, as packing depends on all that came before."""
    return chunking.semantic(docs(spark, sf_dir).withColumnRenamed("id", "doc"), 200, 20, 0.55, 60)


@query(
    f"""WITH {SQL_NODES}, p AS (SELECT manual AS doc, page, sum(len(regexp_extract_all(text, '{_SPACE}'))) AS tokens FROM nodes WHERE manual IS NOT NULL AND page > 0 GROUP BY ALL),
u AS (SELECT doc, page, sum(tokens) OVER (PARTITION BY doc ORDER BY page) AS upto FROM p), s AS (SELECT DISTINCT manual AS doc, start_token AS start FROM who_chunks_semantic WHERE manual IS NOT NULL AND start_token IS NOT NULL)
SELECT s.doc, CAST(start AS BIGINT) AS start, CAST(coalesce(min(page), -1) AS BIGINT) AS page FROM s LEFT JOIN u ON u.doc = s.doc AND start < upto GROUP BY ALL"""
)
def token_to_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each chunk's first token, by the token counts of its manual's pages."""
    n = nodes(spark, sf_dir).where("manual is not null and page > 0").withColumn("n", F.size(F.regexp_extract_all("text", F.lit(_SPACE), F.lit(0))))
    starts = read(spark, sf_dir, "who_chunks_semantic").where("manual is not null and start_token is not null").select(F.col("manual").alias("doc"), F.col("start_token").alias("start")).distinct()
    return longs(chunking.token_to_page(n.groupBy(F.col("manual").alias("doc"), "page").agg(F.sum("n").alias("tokens")), starts))


_MARK = "<<<PAGE_BREAK>>>"


@query(
    f"""WITH c AS (SELECT manual AS doc, doc_id AS chunk_no, text || CASE WHEN doc_id % 3 = 0 THEN '{_MARK}' ELSE '' END AS text FROM documents WHERE text IS NOT NULL AND manual IS NOT NULL),
n AS (SELECT *, (length(text) - length(replace(text, '{_MARK}', ''))) / 16 AS n, replace(text, '{_MARK}', '') AS bare FROM c)
SELECT doc, chunk_no, CAST(1 + coalesce(sum(n) OVER (PARTITION BY doc ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS page, len(regexp_extract_all(bare, '{_SPACE}')) AS tokens,
trim(regexp_replace(replace(bare, chr(8204), ''), '\\s+', ' ', 'g')) AS text FROM n"""
)
def page_by_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages counted by markers; here every third document of a manual ends with one."""
    d = read(spark, sf_dir, "documents").where("text is not null and manual is not null")
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.lit(_MARK)).otherwise(""))
    return chunking.page_by_marker(d.select(F.col("manual").alias("doc"), F.col("doc_id").alias("chunk_no"), text.alias("text")))


@query("SELECT id, format('T_{:05d}', row_number() OVER (ORDER BY id)) AS node_id FROM (SELECT DISTINCT id FROM who_chunks_semantic WHERE id IS NOT NULL)")
def id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.id_map(read(spark, sf_dir, "who_chunks_semantic").where("id is not null"))


_UNIT = """v AS (SELECT chunk_id AS id, embedding FROM chunk_vectors WHERE chunk_id IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY row_id DESC) = 1)"""


def _current_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    fine = (F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    good = read(spark, sf_dir, "chunk_vectors").where(F.col("chunk_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    return good.groupBy(F.col("chunk_id").alias("id")).agg(F.max_by("embedding", "row_id").alias("embedding"))


@query(f"WITH {_UNIT} SELECT rel_id, src_chunk_id, dst_chunk_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS weight FROM rel_text_text JOIN v a ON a.id = src_chunk_id JOIN v b ON b.id = dst_chunk_id")
def edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner products of the current vectors of each similarity edge's ends."""
    e = read(spark, sf_dir, "rel_text_text").select("rel_id", "src_chunk_id", "dst_chunk_id")
    kept, _ = vectors.edge_cosines(e, _current_vectors(spark, sf_dir), "src_chunk_id", "dst_chunk_id")
    return kept.select("rel_id", "src_chunk_id", "dst_chunk_id", F.round("weight", 6).alias("weight"))


@query(f"WITH {_UNIT} SELECT rel_id FROM rel_text_text WHERE src_chunk_id IS NULL OR dst_chunk_id IS NULL OR src_chunk_id NOT IN (SELECT id FROM v) OR dst_chunk_id NOT IN (SELECT id FROM v)")
def edges_without_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "rel_text_text").select("rel_id", "src_chunk_id", "dst_chunk_id")
    return vectors.edge_cosines(e, _current_vectors(spark, sf_dir), "src_chunk_id", "dst_chunk_id")[1].select("rel_id")


_EDGES = """edges AS (SELECT src_chunk_id AS src, dst_chunk_id AS dst, 'SIMILAR_TO' AS rel_type, coalesce(cosine, 0) AS score FROM rel_text_text WHERE src_chunk_id IS NOT NULL AND dst_chunk_id IS NOT NULL
  UNION ALL SELECT chunk_id, img_id, 'HAS_IMAGE', coalesce(score, 0) FROM rel_text_image WHERE chunk_id IS NOT NULL AND img_id IS NOT NULL)"""


def edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    tt = read(spark, sf_dir, "rel_text_text").select(F.col("src_chunk_id").alias("src"), F.col("dst_chunk_id").alias("dst"), F.lit("SIMILAR_TO").alias("rel_type"), F.col("cosine").alias("score"))
    ti = read(spark, sf_dir, "rel_text_image").select(F.col("chunk_id").alias("src"), F.col("img_id").alias("dst"), F.lit("HAS_IMAGE").alias("rel_type"), "score")
    return tt.union(ti).where("src is not null and dst is not null")


_NEAR = f"""near AS (SELECT seed, dst, arg_max(rel_type, (score, rel_type)) AS rel_type, max(score) AS score FROM (
  SELECT src AS seed, dst, rel_type, score FROM edges WHERE src IN (SELECT id FROM hits) QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, dst, rel_type) <= {{0}}) GROUP BY seed, dst)""".replace("{0}", "15")


@query(f"WITH {SQL_HITS}, {_EDGES}, {_NEAR} SELECT * FROM near")
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 best outgoing edges of each text that a logged answer names."""
    return graph.neighbors(edge_table(spark, sf_dir), _answer_texts(spark, sf_dir), 15)


@query(
    f"""WITH {SQL_HITS}, {_EDGES}, {_NEAR}, seeds AS (SELECT qid, id, 1.0 / (rank + 1) AS score FROM hits), g AS (SELECT qid, dst AS id, max(near.score) AS score FROM hits JOIN near ON seed = hits.id GROUP BY ALL),
a AS (SELECT qid, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS h FROM seeds WINDOW w AS (PARTITION BY qid)),
b AS (SELECT qid, id, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS g FROM g WINDOW w AS (PARTITION BY qid)),
f AS (SELECT qid, id, round(0.65 * coalesce(h, 0) + 0.35 * coalesce(g, 0), 6) AS score FROM a FULL JOIN b USING (qid, id)), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM f),
k AS (SELECT r.*, CASE WHEN id[1:2] = 'T_' THEN 'text' WHEN id[1:2] = 'I_' THEN 'image' END AS kind, (SELECT count(*) FROM seeds s WHERE s.qid = r.qid) AS seeds FROM r)
SELECT qid, id, score, kind, row_number() OVER (PARTITION BY qid, kind ORDER BY rank) AS place FROM k WHERE kind IS NOT NULL QUALIFY place <= CASE WHEN kind = 'text' THEN greatest(8, seeds) ELSE 6 END"""
)
def graph_fused_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of logged answers fused with their neighbours in the graph, cut to texts and images."""
    from ..operators import fusion

    hits = _answer_texts(spark, sf_dir)
    seeds = hits.select("qid", "id", (1.0 / (F.col("rank") + 1)).alias("score"))
    near = hits.select("qid", F.col("id").alias("seed")).join(graph.neighbors(edge_table(spark, sf_dir), hits, 15), "seed")
    return longs(fusion.split_kinds(fusion.graph_fused(seeds, near), seeds))


@query(f"WITH {SQL_HITS}, {SQL_NODES} SELECT qid, id, rank, manual, page, text FROM hits JOIN nodes USING (id)")
def ordered_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ordered_fetch(_answer_texts(spark, sf_dir), nodes(spark, sf_dir)).select("qid", "id", "rank", "manual", "page", "text")


_IMAGES = "imgs AS (SELECT img_id, max(path) AS path FROM nodes_image WHERE img_id IS NOT NULL GROUP BY img_id)"


@query(
    f"""WITH {SQL_HITS}, {_IMAGES}, b AS (SELECT qid, img_id, max(coalesce(score, 0)) AS score FROM hits JOIN rel_text_image ON chunk_id = id WHERE img_id IS NOT NULL GROUP BY ALL)
SELECT qid, img_id, path, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, img_id) AS rank FROM b JOIN imgs USING (img_id) QUALIFY rank <= 3"""
)
def ranked_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = read(spark, sf_dir, "nodes_image").where("img_id is not null").groupBy("img_id").agg(F.max("path").alias("path"))
    return longs(graph.ranked_images(_answer_texts(spark, sf_dir), read(spark, sf_dir, "rel_text_image").select("chunk_id", "img_id", "score"), i))


@query(
    """SELECT DISTINCT t.chunk_id, i.img_id, 0.61::DOUBLE AS score, 'page_match' AS method FROM nodes_text t JOIN nodes_image i ON i.manual = t.manual AND i.page = t.page WHERE t.page > 0 AND t.chunk_id IS NOT NULL AND i.img_id IS NOT NULL"""
)
def page_match_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "nodes_text").where("chunk_id is not null")
    return graph.page_match_edges(t, read(spark, sf_dir, "nodes_image").where("img_id is not null")).distinct()


@query(
    """WITH l AS (SELECT answer_id, question, answer, confidence, answered_at, list_sort(list_distinct(list_filter(coalesce(text_ids, []), lambda x: x IS NOT NULL))) AS text_ids, list_sort(list_distinct(list_filter(coalesce(image_ids, []), lambda x: x IS NOT NULL))) AS image_ids
FROM answer WHERE answered_at IS NOT NULL ORDER BY answered_at DESC, answer_id LIMIT 50) SELECT answer_id, question, answer, confidence, answered_at, array_to_string(text_ids, ' ') AS text_ids, array_to_string(image_ids, ' ') AS image_ids FROM l"""
)
def recent_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 newest answers."""
    return graph.recent_answers(read(spark, sf_dir, "answer"), 50).withColumns({c: F.array_join(c, " ") for c in ("text_ids", "image_ids")})


@query("SELECT DISTINCT answer_id, kind, id FROM (SELECT answer_id, 'BASED_ON_TEXT' AS kind, unnest(text_ids) AS id FROM answer UNION ALL SELECT answer_id, 'INCLUDES_IMAGE', unnest(image_ids) FROM answer) WHERE id IS NOT NULL")
def answer_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, imgs = graph.bridges(read(spark, sf_dir, "answer"))
    one = lambda df, kind, c: df.select("answer_id", F.lit(kind).alias("kind"), F.col(c).alias("id"))
    return one(texts, "BASED_ON_TEXT", "chunk_id").union(one(imgs, "INCLUDES_IMAGE", "img_id"))


@query(
    """SELECT chunk_id, max(loaded_at) AS loaded_at, arg_max(manual, loaded_at) AS manual FROM (SELECT chunk_id, manual, loaded_at FROM nodes_text WHERE chunk_id IS NOT NULL) GROUP BY chunk_id"""
)
def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text nodes after loading 2025's rows over the earlier ones: each key's last row."""
    n = read(spark, sf_dir, "nodes_text").select("chunk_id", "manual", "loaded_at")
    old, new = n.where("loaded_at < timestamp_ntz'2025-01-01'"), n.where("loaded_at >= timestamp_ntz'2025-01-01' or loaded_at is null")
    return graph.upsert_nodes(old, new, "chunk_id", "loaded_at").select("chunk_id", "loaded_at", "manual")


@query(
    """SELECT src_chunk_id, dst_chunk_id, max(rel_id) AS rel_id, arg_max(coalesce(cosine, -9), rel_id) AS cosine FROM rel_text_text WHERE src_chunk_id IN (SELECT chunk_id FROM nodes_text) AND dst_chunk_id IN (SELECT chunk_id FROM nodes_text) GROUP BY ALL"""
)
def edge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity edges, the last export of each, whose ends exist."""
    e = read(spark, sf_dir, "rel_text_text").select("src_chunk_id", "dst_chunk_id", "rel_id", F.coalesce("cosine", F.lit(-9.0)).alias("cosine"))
    ids = read(spark, sf_dir, "nodes_text").where("chunk_id is not null").select(F.col("chunk_id").alias("id"))
    return graph.upsert_edges(e.where("rel_id % 2 = 0"), e.where("rel_id % 2 = 1"), "src_chunk_id", "dst_chunk_id", "rel_id", ids, ids)


@query("SELECT 'Text' AS what, count(*) AS n FROM nodes_text UNION ALL SELECT 'Image', count(*) FROM nodes_image UNION ALL SELECT 'SIMILAR_TO', count(*) FROM rel_text_text UNION ALL SELECT 'HAS_IMAGE', count(*) FROM rel_text_image UNION ALL SELECT 'Answer', count(*) FROM answer")
def graph_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"Text": "nodes_text", "Image": "nodes_image", "SIMILAR_TO": "rel_text_text", "HAS_IMAGE": "rel_text_image", "Answer": "answer"}
    return graph.summary({k: read(spark, sf_dir, v) for k, v in names.items()})


@query("SELECT chunk_id, count(*) AS n FROM nodes_text WHERE chunk_id IS NOT NULL GROUP BY chunk_id HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node keys that break uniqueness."""
    return graph.duplicates(read(spark, sf_dir, "nodes_text"), "chunk_id")


@query("SELECT manual, CAST(page AS BIGINT) AS page, array_to_string(list_sort(list(DISTINCT path)), ' ') AS paths FROM nodes_image WHERE manual IS NOT NULL AND page IS NOT NULL AND path IS NOT NULL GROUP BY ALL")
def page_images_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(images.page_map(read(spark, sf_dir, "nodes_image")).withColumn("paths", F.array_join("paths", " ")))


@query("SELECT DISTINCT img_id, path, '/static/' || nullif(regexp_extract(path, '[^\\\\/]*$'), '') AS url FROM nodes_image")
def image_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nodes_image").select("img_id", "path", images.url(F.col("path")).alias("url")).distinct()


@query("SELECT path, lower(path[-4:]) = '.png' AND length(path) > 12 AS ok FROM (SELECT DISTINCT path FROM nodes_image WHERE path IS NOT NULL)")
def image_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check of image bytes, on bytes made up from the paths: a PNG signature for .png paths."""
    p = read(spark, sf_dir, "nodes_image").where("path is not null").select("path").distinct()
    content = F.concat(F.when(F.lower(F.right("path", F.lit(4))) == ".png", F.unhex(F.lit(images.PNG))).otherwise(F.unhex(F.lit("00" * 8))), F.encode("path", "UTF-8"))
    return images.verify(p.select("path", content.alias("content")), 8 + 12)
