"""One place for callers: the graph with its queries, hybrid search, and asking in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import fusion, graph, lexical, understanding, vectors
from .plans.ask import ask as _ask
from .runtime import cut


class Graph:
    """Text and image nodes and their edges as tables.

    ``texts``: id, page, text; ``images``: img_id, path, page; ``edges``: src, dst, rel_type, score; ``answers``: as logged.
    """

    def __init__(self, texts: DataFrame, images: DataFrame, edges: DataFrame, answers: DataFrame | None = None) -> None:
        self.texts, self.images, self.edges, self.answers = texts, images, edges, answers

    def neighbors(self, seeds: DataFrame, limit: int = 50, rel_types: tuple[str, ...] = ("SIMILAR_TO", "HAS_IMAGE")) -> DataFrame:
        return graph.neighbors(self.edges, seeds, limit, rel_types)

    def fetch_texts(self, ids: DataFrame) -> DataFrame:
        return self.texts.join(ids.select("id").distinct(), "id", "left_semi")

    def fetch_images(self, ids: DataFrame) -> DataFrame:
        return self.images.join(ids.select(F.col("id").alias("img_id")).distinct(), "img_id", "left_semi")

    def image_edges(self) -> DataFrame:
        return self.edges.where("rel_type = 'HAS_IMAGE'").select(F.col("src").alias("chunk_id"), F.col("dst").alias("img_id"), "score")

    def ranked_images(self, hits: DataFrame, limit: int = 3) -> DataFrame:
        return graph.ranked_images(hits, self.image_edges(), self.images.select("img_id", "path"), limit)

    def validate_concepts(self, understood: DataFrame) -> DataFrame:
        return understanding.validate(understood, self.texts)

    def store_answers(self, new: DataFrame) -> Graph:
        """The graph with ``new`` answers appended."""
        all_ = new if self.answers is None else self.answers.unionByName(new, allowMissingColumns=True)
        return Graph(self.texts, self.images, self.edges, all_)

    def recent_answers(self, limit: int = 10) -> DataFrame:
        if self.answers is None:
            raise ValueError("this graph has no answers")
        return graph.recent_answers(self.answers, limit)

    def ask(self, questions: DataFrame, mode: str = "dense") -> DataFrame:
        return _ask(questions, self.texts, self.edges, self.images, self.image_edges(), mode)


def hybrid(
    g: Graph, queries: DataFrame, topk: int = 12, graph_limit: int = 15, alpha: float = 0.65, beta: float = 0.35, least_texts: int = 8, use_lexical: bool = True, ws: float = 0.65, wb: float = 0.35, embedder: vectors.Embedder | None = None
) -> DataFrame:
    """qid, id, score, kind, place for queries (qid, text): dense and lexical hits, fused with their neighbours in the graph."""
    vecs = cut(vectors.embed(g.texts.select("id", "text"), "text", embedder).select("id", "embedding"), "vectors")
    seeds = vectors.topk(vecs, vectors.embed(queries, "text", embedder).select("qid", "embedding"), topk).select("qid", "id", "score")
    if use_lexical:
        weights, vocab = lexical.tfidf(g.texts.select("id", "text"))
        seeds = fusion.hybrid(seeds, lexical.search(weights, vocab, queries, topk).select("qid", "id", "score"), ws, wb).select("qid", "id", "score")
    seeds = cut(seeds, "seeds")
    near = seeds.select("qid", F.col("id").alias("seed")).join(g.neighbors(seeds, graph_limit), "seed")
    return fusion.split_kinds(fusion.graph_fused(seeds, near, alpha, beta), seeds, least_texts)
