"""The core's operators on hand-checkable cases and odd inputs."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from manuscope.functions import text as T
from manuscope.operators import answering, chunking, cleaning, fusion, gating, graph, images, lexical, skew, understanding, vectors
from manuscope.operators.components import connected_components
from manuscope.operators.orphans import REFS, OrphanState
from manuscope.sources import io


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("line,want", [("12", True), ("12345", False), ("iv", True), ("mild", True), ("Part II 14", True), ("word", False)])
def test_page_number(spark, line, want):
    assert one(spark, T.is_page_number(F.col("t")), t=line) == want


@pytest.mark.parametrize("text,want", [("a-\nb-\nc", "ab-\nc"), ("well-\nKnown", "wellKnown"), ("9-\n8", "9-\n8")])
def test_dehyphenate(spark, text, want):
    assert one(spark, T.dehyphenate(F.col("t")), t=text) == want


def test_cleaning(spark):
    assert one(spark, T.squeeze(F.col("t")), t="a\n\nb") == "a\nb"
    assert one(spark, T.nfkc(F.col("t")), t="ﬁ①") == "fi1"
    lines = spark.createDataFrame([("d", 1, "foo\nbar.\nbaz")], "doc string, page int, text string")
    assert sorted(r.text for r in cleaning.unwrap(cleaning.page_lines(lines)).collect()) == ["baz", "foo bar."]
    pages = spark.createDataFrame([("d", i, f"Head\nbody {i} of it\n{i}") for i in range(1, 6)] + [("e", 1, None)], "doc string, page int, text string")
    assert [(r.line, r.top) for r in cleaning.repeated_lines(pages).collect()] == [("Head", 5)]
    assert {r.text for r in cleaning.clean_pages(pages).where("doc = 'd'").collect()} == {f"body {i} of it" for i in range(1, 6)}
    assert cleaning.clean_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("n,want", [(0, []), (1000, [(0, 1000)]), (1001, [(0, 1000), (850, 1001)]), (2500, [(0, 1000), (850, 1850), (1700, 2500)])])
def test_baseline_windows(spark, n, want):
    df = spark.createDataFrame([("d", " ".join(["t"] * n))], "doc string, text string")
    got = chunking.baseline(df)
    assert sorted((r.start_token, r.end_token) for r in got.collect()) == want
    with pytest.raises(ValueError):
        chunking.baseline(df, 5, 5)


def test_token_to_page_and_markers(spark):
    pages = spark.createDataFrame([("d", 1, 3), ("d", 2, 2), ("d", 3, 4)], "doc string, page int, tokens int")
    starts = spark.createDataFrame([("d", x) for x in (0, 2, 3, 5, 9, None)], "doc string, start int")
    assert {r.start: r.page for r in chunking.token_to_page(pages, starts).collect()} == {0: 1, 2: 1, 3: 2, 5: 3, 9: -1, None: -1}
    chunks = spark.createDataFrame([("d", i, "x" + T.BREAK * n) for i, n in enumerate((1, 0, 2, 0))], "doc string, chunk_no int, text string")
    assert [r.page for r in chunking.page_by_marker(chunks).orderBy("chunk_no").collect()] == [1, 2, 2, 4]


def test_semantic_chunks_keep_sizes(spark):
    text = " ".join(f"Sentence number {i} has some words here." for i in range(200))
    rows = chunking.semantic(spark.createDataFrame([("d", text), ("e", None), ("f", "short one")], "doc string, text string"), 100, 20, 0.55, 40).collect()
    d = [r for r in rows if r.doc == "d"]
    assert max(r.n_tokens for r in d) <= 100 and len(d) > 10 and [r.text for r in rows if r.doc == "f"] == ["short one"]
    assert all(b.start_token == a.end_token - 20 for a, b in zip(d, d[1:]))
    with pytest.raises(ValueError):
        chunking.semantic(spark.createDataFrame([], "doc string, text string"), 100, 50, 0.5, 40)


def test_sentences_guard_abbreviations(spark):
    assert one(spark, T.sentences(F.col("t")), t="See Dr. Who e.g. today. Then go! Done") == ["See Dr. Who e.g. today.", "Then go!", "Done"]


def test_topk_ties_nulls_and_allow(spark):
    c = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0]), ("n", None)], "id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, embedding array<float>")
    assert [(r.id, r.rank) for r in vectors.topk(c, q, 2).orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    allow = spark.createDataFrame([(1, "c"), (1, "n")], "qid long, id string")
    assert [r.id for r in vectors.topk(c, q, 2, allow=allow).collect()] == ["c"]
    assert vectors.topk(c, q.limit(0), 2).count() == 0 and vectors.topk(c.limit(0), q, 2).count() == 0


def test_fusion(spark):
    s = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.5), (1, "c", 0.1), (2, "x", 0.3), (2, "y", 0.3)], "qid long, id string, score double")
    assert {(r.qid, r.id): round(r.norm, 6) for r in fusion.minmax(s).collect()} == {(1, "a"): 1, (1, "b"): 0.5, (1, "c"): 0, (2, "x"): 1, (2, "y"): 1}
    lex = spark.createDataFrame([(1, "b", 2.0), (1, "d", 1.0)], s.schema)
    assert [(r.id, r.score) for r in fusion.hybrid(s.where("qid = 1"), lex).orderBy("rank").collect()] == [("b", 0.7), ("a", 0.6), ("c", 0.0), ("d", 0.0)]
    seeds = spark.createDataFrame([(1, "T_1", 0.7), (1, "T_2", 0.6), (1, "T_3", 0.0)], s.schema)
    near = spark.createDataFrame([(1, "T_3", 0.9), (1, "T_4", 0.4), (1, "I_1", 0.61)], "qid long, dst string, score double")
    fused = fusion.graph_fused(seeds, near)
    assert [(r.id, r.score) for r in fused.orderBy("rank").collect()] == [("T_1", 0.65), ("T_2", 0.557143), ("T_3", 0.35), ("I_1", 0.147), ("T_4", 0.0)]
    assert fusion.split_kinds(fused, seeds).where("kind = 'image'").count() == 1
    pieces = spark.createDataFrame([(1, f"t{i}", i, "x" * n) for i, n in enumerate((10, 3000, 600, 5))], "qid long, id string, rank int, text string")
    assert sorted(r.id for r in fusion.pack_context(pieces).collect()) == ["t0", "t1"]


@pytest.mark.parametrize(
    "question,intent,concepts",
    [
        ("What is biosafety level 2?", "definition", ["biosafety level", "biosafety level 2", "level 2", "biosafety", "level"]),
        ("What is the difference between a freezer and a refrigerator?", "definition", ["difference between", "difference between freezer", "between freezer", "between freezer and", "freezer and", "freezer and refrigerator", "and refrigerator", "difference", "between", "freezer"]),
        ("Compare bsl-2 and bsl-3", "comparison", ["bsl 2", "bsl 2 bsl", "2 bsl", "2 bsl 3", "bsl 3", "bsl", "bsl"]),
        ("How to sterilize an autoclave", "procedure", ["sterilize autoclave", "sterilize", "autoclave"]),
        ("Staining of blood films", "procedure", ["staining blood", "staining blood films", "blood films", "staining", "blood", "films"]),
        ("Why is PPE required?", "explanation", ["ppe required", "ppe", "required"]),
        ("How does a centrifuge work?", "explanation", ["centrifuge"]),
        ("WHO guidelines", "fact_lookup", ["guidelines"]),
        ("centrifuge maintenance", "fact_lookup", ["centrifuge maintenance", "centrifuge", "maintenance"]),
        ("Can gloves be reused?", "yesno", ["gloves be", "gloves be reused", "be reused", "gloves", "reused"]),
    ],
)
def test_understanding(spark, question, intent, concepts):
    r = understanding.understand(spark.createDataFrame([(1, question)], "qid long, question string")).first()
    assert (r.intent, r.core_concepts) == (intent, concepts)


def test_null_questions(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "qid long, question string")
    assert understanding.understand(df).count() == 2 and understanding.expansions(understanding.understand(df)).count() == 2


@pytest.mark.parametrize("text,role", [("A hood is a device.", "definition"), ("Level 2 laboratory", "definition"), ("Step 1: wash", "procedure"), ("x | y | z | v | w", "table"), ("soap, such as bar", "example"), ("hello", "general")])
def test_roles(spark, text, role):
    assert one(spark, T.content_role(F.col("t")), t=text) == role


def test_evidence(spark):
    for intent, text, want in [("yesno", "We know it", (True, "explicit affirmation or negation")), ("fact_lookup", "plain words", (False, "missing explicit facts or values")), ("odd", "any", (True, "intent not restricted"))]:
        assert tuple(one(spark, T.evidence(F.col("i"), F.col("t")), i=intent, t=text)) == want


def test_bundles(spark):
    d, p = "It is defined as x.", "The procedure goes on."
    rows = [("A", 1, d), ("B", 2, "plain"), ("C", 50, d), ("D", 51, p), ("E", 3, d)]
    ev = spark.createDataFrame([(1, x, pg, t, i) for i, (x, pg, t) in enumerate(rows)], "qid long, id string, page int, text string, rank int")
    b = answering.bundles(ev)
    got = {}
    for r in b.orderBy("bundle", "pos").collect():
        got.setdefault(r.bundle, []).append(r.id)
    assert got == {0: ["A", "B", "C", "E"], 1: ["D"]}
    assert {r.bundle: r.score for r in answering.bundle_scores(b).collect()} == {0: 0.3, 1: 0.6}
    assert [r.id for r in answering.flatten(b).orderBy("place").collect()] == ["D", "A", "B", "C", "E"]


def test_gates_fall_back_and_abstain(spark):
    ev = spark.createDataFrame([(1, "What is bsl?", "definition", ["bsl"], [], "a", 300, "nothing here", 1), (2, "What is bsl?", "definition", ["bsl"], [], "b", 80, "nothing", 1), (2, "What is bsl?", "definition", ["bsl"], [], "c", 300, "nothing", 2)], "qid long, question string, intent string, core_concepts array<string>, entities array<string>, id string, page int, text string, rank int")
    assert sorted(r.id for r in gating.section_filter(ev).collect()) == ["a", "b"]
    q = spark.createDataFrame([(1, "definition", True, "phrase", ["bsl"]), (3, "yesno", False, "none", []), (4, "yesno", True, "phrase", [])], "qid long, intent string, found boolean, match_quality string, core_concepts array<string>")
    out = {r.qid: r for r in gating.abstention(q, gating.with_evidence(ev)).collect()}
    assert all(r.abstained and r.reason for r in out.values()) and "too brief" in out[1].reason and "No content" in out[4].reason
    assert {r.qid: r.failure for r in gating.final_gates(q, gating.with_evidence(ev)).collect()} == {1: "no_intent_aligned_evidence", 3: "no_chunks_after_retrieval", 4: "no_chunks_after_retrieval"}


def test_definition_lock(spark):
    row = lambda q, i, text, rank: (q, "What is it?", "definition", ["safety cabinet", "airflow"], [], i, 1, text, rank)
    ev = [row(1, "a", "A safety hood is a box.", 1), row(1, "b", "The airflow is a stream of the cabinet.", 2), row(2, "c", "Nothing at all here.", 1), row(4, "e", "The airflow is a stream.", 1), row(5, "e", "The airflow is a stream.", 1)]
    ev += [row(6, f"n{i}", "It is a box.", i) for i in range(1, 11)] + [row(6, "z", "The safety cabinet and the airflow are a pair.", 11)]
    ev = gating.with_evidence(spark.createDataFrame(ev, "qid long, question string, intent string, core_concepts array<string>, entities array<string>, id string, page int, text string, rank int"))
    both = ["safety cabinet", "airflow"]
    q = [(1, "definition", both, False), (2, "definition", both, False), (3, "definition", both, True), (4, "definition", both, True), (5, "definition", both, False), (6, "definition", both, False), (7, "yesno", both, False), (8, "definition", ["box"], False)]
    out = {r.qid: (r.share, r.locked) for r in gating.definition_lock(spark.createDataFrame(q, "qid long, intent string, core_concepts array<string>, fallback_triggered boolean"), ev).collect()}
    # words of all texts count together; without evidence or longer concepts a question is locked; a fallback lowers the bound
    assert out == {1: (1.0, False), 2: (0.0, True), 3: (0.0, True), 4: (0.5, False), 5: (0.5, True), 6: (0.0, True), 8: (0.0, True)}


def test_concept_filter_neighbours(spark):
    row = lambda i, text: (1, "What is a viewport text?", "definition", [], [], i, 1, text, 1)
    ev = spark.createDataFrame([row("a", "viewport"), row("b", "none of it"), row("c", "nothing")], "qid long, question string, intent string, core_concepts array<string>, entities array<string>, id string, page int, text string, rank int")
    near = spark.createDataFrame([("b", "T_viewport", "SIMILAR_TO", 0.5), ("c", "I_1", "HAS_IMAGE", 0.9)], "seed string, dst string, rel_type string, score double")
    assert [r.id for r in gating.concept_filter(ev).collect()] == ["a"]
    assert sorted(r.id for r in gating.concept_filter(ev, near).collect()) == ["a", "b"]


def test_validation_by_phrases(spark):
    q = understanding.understand(spark.createDataFrame([(1, "What is biosafety level 2?"), (2, "Where is the centrifuge?"), (3, "What is zzqy?"), (4, None)], "qid long, question string"))
    rows = [(f"t{i:03d}", 1, "The Biosafety-Level  2 room.") for i in range(250)] + [("u", 2, "biosafety, level 2"), ("v", None, "Ultracentrifuge, centrifuge-rotor"), ("w", 4, None), ("x", 5, "ultracentrifuge only"), ("y", 6, "a note on Biosafety")]
    out = {r.qid: r for r in understanding.validate(q, spark.createDataFrame(rows, "id string, page int, text string")).collect()}
    assert out[1].match_quality == "phrase" and out[1].text_ids == [f"t{i:03d}" for i in range(200)] and "biosafety level 2" in out[1].matched_concepts
    assert out[2].text_ids == ["v"] and not out[2].fallback_triggered and out[3].match_quality == "section" and out[3].fallback_triggered and not out[4].found
    assert out[3].text_ids == [f"t{i:03d}" for i in range(200)]


def test_blocks_meet_all_rows(spark, monkeypatch):
    from manuscope.operators import blocks

    for name, v in (("BLOCK", 7), ("PART", 11), ("STEP", 4)):
        monkeypatch.setattr(blocks, name, v)
    rnd = random.Random(3)
    docs = [(i, " ".join(rnd.choice("oak elm ash fir yew box bay".split()) for _ in range(rnd.randint(0, 6)))) for i in range(60)] + [(60, None)]
    asked = [(100 + i, " ".join(rnd.sample("oak elm ash fir yew box bay".split(), 3))) for i in range(20)] + [(130, ""), (131, None)]
    got = {(r.qid, r.id, r.score, r["rank"]) for r in lexical.coverage_topk(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(asked, "qid long, text string"), 4).collect()}
    want = set()
    for q, t in asked:
        words = set((t or "").split())
        s = sorted(((-len(words & set((x or "").split())), i) for i, x in docs))
        want |= {(q, i, round(-n / len(words), 6), r) for r, (n, i) in enumerate(s[:4], 1) if n}
    assert got == want and want
    v = spark.createDataFrame([(f"v{i:02d}", [float(i % 5), 1.0]) for i in range(30)], "id string, embedding array<float>")
    top = vectors.topk(v, spark.createDataFrame([(q, [1.0, float(q)]) for q in range(9)], "qid int, embedding array<float>"), 3)
    assert all([r.id for r in sorted(top.where(F.col("qid") == q).collect(), key=lambda r: r["rank"])] == ["v04", "v09", "v14"] for q in range(9))
    d = spark.createDataFrame([r for r in docs if r[1]], "id long, text string")
    every = lexical.knn_edges(d, None, 3, 0.2)
    assert every.where("src = dst").count() == 0 and every.where("src < 20").count() == lexical.knn_edges(d, d.where("id < 20"), 3, 0.2).count() > 0


def test_temporary_folder_is_local_only(spark, monkeypatch, tmp_path):
    from manuscope import runtime

    kept = list(runtime._made)
    monkeypatch.setattr(runtime, "_made", [])
    df = runtime.cut(spark.range(5), "gone")
    path = runtime._made[-1]
    assert df.count() == 5 and os.path.isdir(path)
    runtime.forget(spark)
    assert not os.path.isdir(path) and runtime._made == [] and kept is not None


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "SIMILAR_TO", None), ("a", "b", "SIMILAR_TO", 0.5), ("a", "c", "HAS_IMAGE", 0.9), ("a", "d", "OTHER", 1.0)], "src string, dst string, rel_type string, score double")
    assert sorted((r.dst, r.score) for r in graph.neighbors(e, spark.createDataFrame([("a",)], "id string")).collect()) == [("b", 0.5), ("c", 0.9)]
    old = spark.createDataFrame([("k", 1, "x"), (None, 1, "n")], "id string, seq int, v string")
    new = spark.createDataFrame([("k", 2, "y"), ("l", 2, "z"), ("l", 2, "z")], old.schema)
    twice = graph.upsert_nodes(graph.upsert_nodes(old, new, "id", "seq"), new, "id", "seq")
    assert sorted((r.id, r.v) for r in twice.collect()) == [("k", "y"), ("l", "z")]
    assert [r.n for r in graph.duplicates(new, "id").collect()] == [2]


def test_components(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (500, 500), (None, 3)], "a long, b long")
    got = {r.vertex: r.component for r in connected_components(df).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[500] == 500
    assert connected_components(df.limit(0)).count() == 0


def test_skewed_lookup(spark, monkeypatch):
    facts = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"))
    table = spark.createDataFrame([("hot", 1), ("4", 2)], "k string, v int")
    monkeypatch.setattr(skew, "BROADCAST_BYTES", -1)
    out = skew.lookup(facts, table, "k", "id")
    assert out.count() == 5000 and out.agg(F.sum("v")).first()[0] == 1667 + 2


def test_orphans_step_by_step(spark):
    day = lambda n: f"2024-01-{n:02d} 00:00:00"
    ts = lambda df, *cs: df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in cs else F.col(c) for c in df.columns])
    refs = lambda *rows: ts(spark.createDataFrame([("r", "f", "p", *x) for x in rows], "rel_table string, field_name string, parent_table string, rel_id long, key string, loaded_at string"), "loaded_at")
    par = lambda *rows: ts(spark.createDataFrame([("p", *x) for x in rows], "parent_table string, key string, loaded_at string, deleted_at string"), "loaded_at", "deleted_at")
    none = par().limit(0)
    status = lambda s: {r.rel_id: r.status for r in s.refs.collect()}
    s = OrphanState.empty(spark).advance(refs((1, "a", day(5)), (2, "b", day(5)), (3, None, day(5)), (4, "a", None)), par(("a", day(4), None)), none)
    assert status(s) == {1: "ok", 2: "missing", 4: "late"}
    s = s.advance(refs((5, "a", day(3))), par(("b", day(2), None)), none)
    assert status(s) == {1: "ok", 2: "ok", 4: "late", 5: "late"}
    s = s.advance(refs().limit(0), none, par(("a", day(4), day(9))))
    assert status(s) == {1: "deleted", 2: "ok", 4: "deleted", 5: "deleted"}
    s = s.advance(refs().limit(0), par(("a", day(1), None), (None, day(1), None)), none)
    assert status(s) == {1: "ok", 2: "ok", 4: "late", 5: "ok"}
    assert [(r.period, r.orphans) for r in s.snapshot().collect()] == [(None, 1)]
    assert REFS.count(",") == 6


def test_images(spark):
    png = bytes.fromhex(images.PNG) + b"x" * 300
    files = spark.createDataFrame([("a.png", png), ("b.png", b"nope"), ("c", None)], "path string, content binary")
    assert {r.path: r.ok for r in images.verify(files).collect()} == {"a.png": True, "b.png": False, "c": False}
    assert one(spark, images.url(F.col("p")), p="x\\y/z.png") == "/static/z.png"

    def decoder(content):
        if not content.startswith(b"\x89PNG"):
            raise ValueError("not a picture")
        return [images.Image(1, i, s, s, content) for i, s in enumerate((10, 50, 60))]

    out = images.extract(files.where("content is not null"), [decoder], per_page=1).collect()
    assert sorted((r.path, r.width, r.error) for r in out) == [("a.png", 50, None), ("b.png", None, "ValueError: not a picture")]


def test_sources(spark, tmp_path):
    p = str(tmp_path)
    chunks = spark.createDataFrame([("c1", "semantic", 0, 2, 2, "é\n\"x\", y"), ("c2", None, None, None, None, None)], io.CHUNK)
    io.write_jsonl(chunks, f"{p}/j")
    assert sorted(map(tuple, io.read_jsonl(spark, f"{p}/j").collect())) == sorted(map(tuple, chunks.collect()))
    nodes = spark.createDataFrame([("T_1", 3, 2, 'a\nb "q", c')], io.TEXT_NODE)
    io.write_csv(nodes, f"{p}/c")
    assert io.read_csv(spark, f"{p}/c", io.TEXT_NODE).collect() == nodes.collect()
    (tmp_path / "n.csv").write_text("﻿ID,Content,Page_Num\nT_1,hello,x\nT_2,\"a\nb\",7\n", encoding="utf-8")
    assert [tuple(r) for r in io.read_nodes_csv(spark, f"{p}/n.csv").select("chunk_id", "page", "text").collect()] == [("T_1", None, "hello"), ("T_2", 7, "a\nb")]
    (tmp_path / "q.txt").write_text("one?\n\n  two \n")
    assert [r.question for r in io.read_questions(spark, f"{p}/q.txt").collect()] == ["one?", "two"]
    pairs = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    assert sorted(map(tuple, io.from_json_object(io.to_json_object(pairs, "k", "v")).collect())) == [("a", "1"), ("b", "2")]
    v = vectors.embed(spark.createDataFrame([(0, "x", "red fox")], "row_id int, id string, text string"))
    io.write_vectors(v, f"{p}/v")
    assert io.read_vectors(spark, f"{p}/v", vectors.HashedWords().name).count() == 1
    with pytest.raises(Exception, match="not made by"):
        io.read_vectors(spark, f"{p}/v", "other").select("embedding").collect()
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.html").write_text("<h1>T</h1><script>x</script><p>body &amp; more</p>")
    pages = io.decode_pages(io.read_files(spark, f"{p}/h", "*.html"), [lambda b: None, io.html_text]).collect()
    assert len(pages) == 1 and "body & more" in pages[0].text and "x" not in pages[0].text.split()
    assert io.first_existing([f"{p}/none", f"{p}/q.txt"]).endswith("q.txt")


def test_lexical_edges(spark):
    docs = spark.createDataFrame([(1, "red fox den"), (2, "red fox den"), (3, None), (4, "")], "id long, text string")
    e = lexical.knn_edges(docs.where("text is not null"), docs.select("id"))
    assert sorted((r.src, r.dst, r.score) for r in e.collect()) == [(1, 2, 1.0), (2, 1, 1.0)]
    assert one(spark, T.coverage(F.lit("The red fox"), F.lit("a fox, the den"))) == pytest.approx(2 / 3)


def test_plans_stay_in_the_engine(spark):
    """Queries of built-in functions have no Python node, and no cross product."""
    import __spark_entry__ as entry

    q = entry.queries()
    for name in ("tfidf_vocab chunk_baseline unwrap_paragraphs neighbors intent core_concepts entities page_match_edges header_footer_lines content_role definition_indicators graph_fused_topk ranked_images "
        "answer_bridges edge_weights context_pack ordered_fetch node_upsert edge_upsert minmax_scores concept_match squeeze_whitespace dehyphenate").split():
        plan = q[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"Python|Pandas|MapInArrow|CartesianProduct", plan), name


def test_logged_questions_are_read(spark):
    """Queries without SQL that search for evidence take the stated queries of the answer log too."""
    import __spark_entry__ as entry
    from manuscope.operators import lexical
    from manuscope.plans.tables import every_question, nodes, questions

    d = "/root/testdata/sf0.001"
    both = questions(spark, d).withColumnRenamed("question", "text")
    want = {r.qid for r in lexical.coverage_topk(nodes(spark, d).select("id", "text"), both, 12).select("qid").distinct().collect()}
    assert any(x >= 20 for x in want) and any(x < 0 for x in want)
    for name in ("bundle_score", "bundle_flatten", "prompts"):
        assert {r.qid for r in entry.queries()[name](spark, d).select("qid").collect()} == want, name
    assert entry.queries()["core_concepts"](spark, d).count() == every_question(spark, d).count() > 50


def test_rest_does_not_import_llm():
    import os

    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "manuscope")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert not re.search(r"^\s*(?:from|import)\s.*\bllm\b", open(os.path.join(folder, f)).read(), re.M), f


def test_api_and_stream(spark, tmp_path):
    from manuscope.api import Graph, hybrid
    from manuscope.streaming import answer_log

    d = "/root/testdata/sf0.001"
    from manuscope.plans.building import edge_table
    from manuscope.plans.tables import nodes, questions

    imgs = spark.read.parquet(f"{d}/nodes_image.parquet").where("img_id is not null").groupBy("img_id").agg(F.max("path").alias("path"), F.max("page").alias("page"))
    g = Graph(nodes(spark, d).select("id", "page", "text"), imgs, edge_table(spark, d), spark.read.parquet(f"{d}/answer.parquet"))
    out = g.ask(questions(spark, d), mode="hybrid").collect()
    assert len(out) == questions(spark, d).count() and all(r.reason for r in out if r.abstained) and any(not r.abstained for r in out)
    assert all(0 <= r.confidence <= 1 for r in out)
    rows = hybrid(g, questions(spark, d).limit(3).withColumnRenamed("question", "text")).collect()
    assert rows and max(r.place for r in rows if r.kind == "text") <= 24
    assert g.recent_answers(3).count() == 3 and g.fetch_texts(g.texts.limit(2)).count() == 2
    src = tmp_path / "in"
    g.answers.repartition(3).write.parquet(str(src))
    answer_log.store(answer_log.read_answers(spark, str(src), 1), str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out" / "answers")).count() == g.answers.count()
    assert spark.read.parquet(str(tmp_path / "out" / "based_on_text")).select("answer_id", "chunk_id").distinct().count() == graph.bridges(g.answers)[0].count()
    table = {r.start: r.answers for r in answer_log.quality(g.answers).collect()}
    assert sum(table.values()) == g.answers.where("answered_at is not null").count()


@pytest.mark.parametrize("small", [False, True])
def test_sparse_blocks_equal_brute_force(spark, monkeypatch, small):
    """Whatever the sizes of passes, parts and blocks: the same best rows, with copies, ties and repeated ids."""
    from collections import Counter
    from math import log, sqrt

    from manuscope.operators import blocks

    if small:
        for name, v in (("PASS", 300), ("HELD", 50), ("WIDE", 16), ("HIGH", 7), ("DENSE", 9)):
            monkeypatch.setattr(blocks, name, v)
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rnd.choices(words, [1 / (i + 1) for i in range(40)], k=rnd.randint(0, 9))) for _ in range(120)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(200 + i, texts[i % 4]) for i in range(30)] + [(3, "w1 w2 w9"), (3, "w2 w30")]
    by: dict = {}
    for i, t in docs:
        w = t.split()
        by.setdefault(i, Counter()).update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    df = Counter(t for c in by.values() for t in c)
    rows = {i: {t: n * (log((1 + len(docs)) / (1 + df[t])) + 1) for t, n in c.items()} for i, c in by.items()}
    norm = {i: sqrt(sum(x * x for x in r.values())) for i, r in rows.items()}
    cos = lambda a, b: sum(x * rows[b].get(t, 0) for t, x in rows[a].items()) / (norm[a] * norm[b] or 1)
    want = {}
    for q in rows:
        s = sorted((-round(cos(q, d), 9), d) for d in rows if d != q)
        want |= {(q, d): -x for x, d in s[:4] if -x >= 0.25}
    table = spark.createDataFrame(docs, "id long, text string")
    got = {(r.src, r.dst): r.score for r in lexical.knn_edges(table, None, 4).collect()}
    assert got.keys() == want.keys() and want and all(got[x] == pytest.approx(want[x], abs=1e-4) for x in want)
    found = lexical.search(*lexical.tfidf(table), spark.createDataFrame([(7, "w2 w30 w1"), (8, "none of these")], "qid long, text string"), 3).collect()
    assert sorted(r["rank"] for r in found) == [1, 2, 3] and {r.qid for r in found} == {7}
    per = lexical.coverage_topk(table.where("id <> 3").withColumn("kind", F.col("id") % 2), spark.createDataFrame([(7, "w10 w11 w12")], "qid long, text string"), 2, by="kind")
    best = lambda k: sorted((-len({"w10", "w11", "w12"} & set(t.split())), i) for i, t in docs if i != 3 and i % 2 == k)[:2]
    assert {(r.kind, r.id, r["rank"]) for r in per.collect()} == {(k, i, n) for k in (0, 1) for n, (_, i) in enumerate(best(k), 1) if _}


@pytest.mark.parametrize("name", ["knn_edges", "tfidf_topk", "chunking_comparison"])
def test_rows_are_not_repeated_for_queries(spark, name):
    """Neither rows nor their terms are copied for the queries, and no row of a text and a term is stored."""
    import __spark_entry__ as entry
    from manuscope import runtime

    before = len(runtime._made)
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Generate|CoGroups", plan)
    for path in runtime._made[before:]:
        assert "term" not in spark.read.parquet(path).columns


@pytest.mark.parametrize("small", [True, False])
def test_repeated_ids_are_added_up_packed(spark, monkeypatch, small):
    """Texts of an id that comes several times count as one, and their words are not gathered for it: only what is packed moves."""
    from collections import Counter
    from math import log

    if not small:
        monkeypatch.setattr(lexical, "BROADCAST_BYTES", -1, raising=False)
    plans, cut = [], lexical.cut
    monkeypatch.setattr(lexical, "cut", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or cut(df, name))
    rnd = random.Random(3)
    docs = [(rnd.choice([None, 1, 1, 1, *range(40)]), " ".join(rnd.choices([f"w{i}" for i in range(12)] + ["-"], k=rnd.randint(0, 8)))) for _ in range(300)]
    by: dict = {}
    for i, t in docs:
        w = [x for x in t.split() if x != "-"]
        by.setdefault(i, Counter()).update(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    tf = sum(by.values(), Counter())
    terms = sorted(tf, key=lambda t: (-tf[t], t))[:60]
    rows, vocab = lexical.tfidf(spark.createDataFrame(docs, "id long, text string"), 60)
    assert vocab.terms == terms
    assert vocab.idf == pytest.approx([log(301 / (1 + sum(t in c for c in by.values()))) + 1 for t in terms])
    got = [(r.id, {vocab.terms[t]: n for t, n in zip(r.terms, r.ws)}) for r in rows.collect()]
    assert len(got) == len(dict(got)) and dict(got) == {i: k for i, c in by.items() if (k := {t: c[t] for t in terms if t in c})}
    assert len(plans) == 3 and not any(re.search(r"collect_list\([^\n]*words", p) for p in plans)
