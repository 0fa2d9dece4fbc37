"""``ask``: a batch of questions through validation, restricted search, filters, gates, bundles and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import answering, fusion, gating, graph, images, lexical, understanding, vectors
from ..runtime import cut


def _hits(q: DataFrame, texts: DataFrame, vecs: DataFrame, allow: DataFrame, mode: str) -> DataFrame:
    """qid, id, rank: the texts that a question may find, by vectors, or by vectors and words."""
    most = F.create_map(*[F.lit(x) for k, v in L.INTENT_PARAMETERS.items() for x in (k, 2 * v[0])])
    dense = vectors.topk(vecs, vectors.embed(q.select("qid", "question"), "question").select("qid", "embedding"), 50, allow=allow)
    if mode == "hybrid":
        weights, vocab = lexical.tfidf(texts.select("id", "text"))
        words = lexical.search(weights, vocab, q.select("qid", F.col("question").alias("text")), 50).join(allow, ["qid", "id"], "left_semi")
        dense = fusion.hybrid(dense.select("qid", "id", "score"), words.select("qid", "id", "score"))
    return dense.join(q.select("qid", "intent"), "qid").where(F.col("rank") <= most[F.col("intent")]).select("qid", "id", "rank")


def ask(questions: DataFrame, texts: DataFrame, edges: DataFrame, image_nodes: DataFrame, image_edges: DataFrame, mode: str = "dense") -> DataFrame:
    """One row a question (qid, question): answer, abstained, reason, confidence, intent and what led there.

    ``texts``: id, page, text; ``edges``: src, dst, rel_type, score; ``image_nodes``: img_id, path, page; ``image_edges``:
    chunk_id, img_id, score.  Questions whose concepts no text holds, whose evidence fails the gates, or whose
    definition is locked, abstain with a fixed text; those that failed for lack of evidence get a second
    search with expanded questions first.  All questions go through each step together.
    """
    u = cut(understanding.understand(questions), "asked")
    v = cut(understanding.validate(u, texts), "validated")
    vecs = cut(vectors.embed(texts.select("id", "text")).select("id", "embedding"), "vectors")
    allow = v.where("found").select("qid", F.explode("text_ids").alias("id"))
    base = u.select("qid", "question", "intent", "core_concepts", "entities")
    near = graph.neighbors(edges, allow, 30)

    def evidence(hits: DataFrame) -> DataFrame:
        rows = hits.join(texts, "id").join(base, "qid").select("qid", "question", "intent", "core_concepts", "entities", "id", "page", "text", "rank")
        return cut(gating.with_evidence(gating.semantic_filter(rows, near)), "evidence")

    first = evidence(_hits(u, texts, vecs, allow, mode))
    judged = u.join(v.select("qid", "found", "match_quality", "fallback_triggered"), "qid")
    lock = cut(gating.definition_lock(judged, first), "lock")
    shut = lock.where("locked").select("qid")
    no = cut(gating.abstention(judged, first), "abstention")
    again = u.join(no.where("abstained"), "qid", "left_semi").join(shut, "qid", "left_anti")
    variants = understanding.expansions(again)
    key = F.concat_ws(":", "qid", "variant")
    found = vectors.topk(vecs, vectors.embed(variants.where("variant <= 5").select(key.alias("qid"), "query"), "query").select("qid", "embedding"), 20)
    found = found.select(F.split("qid", ":")[0].cast("long").alias("qid"), F.split("qid", ":")[1].cast("int").alias("variant"), "id", "rank").join(texts.select("id", "page"), "id")
    second_hits = gating.pass2(variants.select("qid", "variant"), found, v.select("qid", F.explode("pages").alias("page")))
    w = Window.partitionBy("qid").orderBy("variant", "rank")
    second = evidence(second_hits.select("qid", "id", F.row_number().over(w).alias("rank")))
    gates = gating.final_gates(again, second)
    used = gates.where("passed").select("qid")
    all_ = cut(first.join(no.where("abstained"), "qid", "left_anti").union(second.join(used, "qid", "left_semi").select(*first.columns)), "used")
    usable = all_.where("matches").join(shut, "qid", "left_anti")
    place = cut(answering.flatten(answering.bundles(usable)), "places")
    ctx = place.join(usable.drop("rank"), ["qid", "id"])
    ans = answering.confidence(u.select("qid", "intent").join(answering.extractive(ctx), "qid"), ctx)
    m = answering.metrics(ans.join(u.select("qid", "intent", "core_concepts"), "qid"))
    pics = graph.ranked_images(place.where("place <= 5").select("qid", "id"), image_edges, image_nodes.select("img_id", "path"), 3).join(image_nodes.select("img_id", "page"), "img_id")
    per = first.groupBy("qid").agg(F.count("*").alias("total"), F.count_if("matches").alias("matched"), F.count_if(~F.col("matches")).alias("rejected"), F.slice(F.array_sort(F.collect_set(F.when(~F.col("matches"), F.col("reason")))), 1, 5).alias("why"))
    ctx_list = ctx.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "id", "page", F.substring("text", 1, 200).alias("preview")))).alias("c"))
    pic_list = pics.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("img_id").alias("id"), "page", images.url(F.col("path")).alias("url")))).alias("i"))
    tried = variants.groupBy("qid").agg(F.array_sort(F.collect_list("query")).alias("queries")).join(second.groupBy("qid").agg(F.count("*").alias("candidates")), "qid", "left").join(gates, "qid", "left")
    metric_cols = [c for c in m.columns if c != "qid"]
    out = u.join(v, "qid").join(no, "qid").join(lock.select("qid", "share", "locked", F.col("reason").alias("lock_reason")), "qid", "left").join(ans, "qid", "left").join(per, "qid", "left").join(ctx_list, "qid", "left").join(pic_list, "qid", "left").join(tried, "qid", "left").join(m.select("qid", F.struct(*metric_cols).alias("metrics")), "qid", "left")
    none = F.col("answer").isNull()
    reason = F.when(none & F.coalesce("locked", F.lit(False)), F.col("lock_reason")).when(none & (F.col("reason") != ""), F.col("reason")).when(none, "No evidence left after the gates.")
    return out.select(
        "qid", "question", F.coalesce("answer", F.lit(L.NOT_FOUND)).alias("answer"), none.alias("abstained"), reason.alias("reason"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "intent", F.slice("core_concepts", 1, 5).alias("core_concepts"),
        F.struct(F.col("found").alias("exists"), "matched_concepts", F.size("text_ids").cast("long").alias("validated_chunks"), "pages", "roles", "match_quality", "fallback_triggered").alias("graph_validation"),
        F.struct(F.col("total").alias("total_retrieved"), F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("rejected", F.lit(0)).alias("rejected"), F.coalesce("why", F.array().cast("array<string>")).alias("rejection_reasons")).alias("evidence_matching"),
        F.when(F.col("queries").isNotNull(), F.struct(F.lit(True).alias("attempted"), F.coalesce("passed", F.lit(False)).alias("used"), F.col("queries").alias("expanded_queries"), F.col("pages").alias("restricted_pages"), F.coalesce("candidates", F.lit(0)).alias("candidates_found"), "reason", F.col("failure").alias("gates_failed"))).alias("pass2"),
        "metrics", F.transform("c", lambda x: F.struct(x["id"].alias("id"), x["page"].alias("page"), x["preview"].alias("preview"))).alias("context_chunks"), F.transform("i", lambda x: F.struct(x["id"].alias("id"), x["page"].alias("page"), x["url"].alias("url"))).alias("images"),
    )
