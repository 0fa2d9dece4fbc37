"""The training-data operators against brute force, round trips and odd inputs."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from manuscope.llm.answers import Judge, broken_answers
from manuscope.llm.automata import Phrases, SuffixAutomaton, covered, left_open
from manuscope.llm.mixing import mix
from manuscope.llm.near_duplicates import near_duplicates, record_groups, record_pairs
from manuscope.llm.neighbours import hilbert_keys, nearest, usable
from manuscope.llm.packing import pack, pack_block
from manuscope.llm.residue import Detector, template_residue, without_residue
from manuscope.llm.scan_noise import Titles, furniture, read_scans, reflow
from manuscope.llm.shared_spans import anchors, shared_in, shared_spans, without_spans
from manuscope.llm.splitting import boundaries, cut_points, split_oversized

WORDS = [f"w{i}" for i in range(400)]
RECORDS = "rec_table int, rec_id string, text string, class_id int, anchor string"


def texts(n, seed, long=60):
    """Texts with near copies, exact copies and odd ones."""
    rnd, out = random.Random(seed), []
    for _ in range(n):
        if out and rnd.random() < 0.5:
            w = list(rnd.choice(out))
            for _ in range(rnd.randint(0, 6)):
                w[rnd.randrange(len(w))] = rnd.choice(WORDS)
            if rnd.random() < 0.3:
                k = rnd.randrange(len(w))
                w = w[k:] + w[:k]
        else:
            w = [rnd.choice(WORDS) for _ in range(rnd.randint(3, long))]
        out.append(w)
    return [" ".join(w) for w in out]


def grams(t, n=3):
    w = re.findall("[a-z0-9]+", (t or "").lower())
    return frozenset(zip(*(w[i:] for i in range(n))))


@pytest.mark.parametrize("threshold,width", [(0.5, 3), (0.8, 5)])
def test_near_duplicates_equal_brute_force(spark, threshold, width):
    rows = [(i % 2, f"r{i:04d}", t, i, "x") for i, t in enumerate(texts(160, 1, 150) + ["", None, " ", "one two", "ONE two"])]
    rows += [rows[3], rows[4]]  # repeated rows
    m = near_duplicates(spark.createDataFrame(rows, RECORDS), threshold, width)
    got = sorted((r[0], r[1], r[2]) for r in record_pairs(m).collect())
    sets = {(a, b): grams(t, width) for a, b, t, *_ in rows}
    want = []
    for (a, x), (b, y) in itertools.combinations(sorted(sets), 2):
        s, t = sets[a, x], sets[b, y]
        if a == b and s and t and len(s & t) / len(s | t) >= threshold:
            want.append((a, x, y))
    assert got == want and want
    groups = {(r.rec_table, r.rec_id): r.group_id for r in record_groups(m).collect()}
    assert all(groups[a, x] == groups[a, y] for a, x, y in want)
    assert set(groups) == {k for k, s in sets.items() if s}


def test_near_duplicates_hot_copies_and_empty(spark):
    same = "a b c d e f g h i j"
    rows = [(0, f"c{i:03d}", same, 0, "") for i in range(60)] + [(0, "z", "a b c d e f g h i k", 0, ""), (0, None, same, 0, "")]
    m = near_duplicates(spark.createDataFrame(rows, RECORDS), 0.5, 3)
    assert m.pairs.count() == 1
    star = record_pairs(m, expand=10)
    assert star.count() == 59 + 1
    assert record_pairs(m).count() == 60 * 59 // 2 + 60
    none = near_duplicates(spark.createDataFrame([], RECORDS), 0.5, 3)
    assert record_pairs(none).count() == 0 and record_groups(none).count() == 0


def test_suffix_automaton_matches_all_factors():
    rnd = random.Random(3)
    for _ in range(30):
        a, b = ("".join(rnd.choice("ab") for _ in range(rnd.randint(1, 30))) for _ in range(2))
        s = SuffixAutomaton()
        s.add(a)
        want = [max(n for n in range(i + 2) if b[i + 1 - n : i + 1] in a) for i in range(len(b))]
        assert s.matching_lengths(b) == want
        marks = set()
        for i, n in enumerate(want):
            if n >= 2:
                marks |= set(range(i - n + 1, i + 1))
        assert covered(want, 2) == len(marks)


def test_phrases_and_delimiters():
    assert [s[2] for s in Phrases([("ab", 1), ("bc", 2)]).spans("abc")] == [1, 2]
    assert left_open("a (b") and left_open("**a") and not left_open("1) a (b)") and not left_open("")


LEX = {"gasket": "en", "étanche": "fr", "wagen": "de", "tapón": "es"}


@pytest.mark.parametrize(
    "question,answer,defect",
    [
        ("Where is the tray?", None, "empty"), ("Where is the tray?", "  ", "empty"), ("Where is the tray?", "N/A", "empty"), ("Where is the tray?", "**Answer**\n\n", "empty"), (None, None, "empty"),
        ("Where is the tray?", "No", None), ("Can the tray stay here?", "Yes, daily", None), ("At what temperature is it kept?", "19 °C", None),
        ("Where is the heavy tray kept?", "Where is the heavy tray kept?", "copy"), ("Where is the heavy tray kept?", "Heavy tray kept, where is the", "copy"),
        ("Where is the heavy tray?", "Where is the heavy tray? It is stored on the second shelf.", None),
        ("Where is the tray?", "Sorry, but I have no idea. Try another wording.", "refusal"), ("Où est le bac ?", "Désolé, je n'en sais rien.", "refusal"),
        ("Where is the tray?", "If you do not know who opened it, treat it as unsafe and call the lead.", None),
        ("Where is the tray?", "El balde queda en la sala junto con el tapón, para que no se pierda.", "other_language"),
        ("Where is the tray?", "The tray is kept on the shelf with the lid (tampon étiqueté).", None),
        ("Where is the tray?", "The tray is kept on the second", "truncated"), ("Where is the tray?", "1. Open the lid.\n2.", "truncated"), ("Where is the tray?", "The lid (of the tray is open.", "truncated"),
        ("Where is the tray?", "- Lift: inner tray\n- Soak: outer lid", None), ("Where is the tray?", "Tray | 3 | on the shelf | 1.5", None),
    ],
)
def test_answer_defects(question, answer, defect):
    assert Judge(LEX).defect(question, answer) == defect


@pytest.mark.parametrize(
    "answer,defect",
    [
        ("I'm sorry, but I can't provide that.", "refusal"), ("As an AI language model, I am unable to provide that information.", "refusal"), ("That is against my guidelines, so I won't discuss it.", "refusal"),
        ("Il vassoio è sul secondo ripiano della cella e deve essere chiuso ogni sera prima della pausa.", "other_language"), ("Taca stoi na drugiej półce i nie może być otwarta, jeśli jest mokra, oraz musi być zamknięta.", "other_language"),
        ("O tabuleiro está na segunda prateleira e não deve ser aberto depois das seis, também está numa caixa.", "other_language"), ("托盘放在冷库的第二层架子上。", "other_language"), ("Autoclave at 121 °C for 30 min", None),
        ("The tray, marked 托盘, is kept on the shelf.", None), ("If I am late, the tray is kept by the night shift until I can help to move it.", None),
    ],
)
def test_answers_of_other_makes(answer, defect):
    assert Judge(LEX).defect("Where is the tray kept in the cold store?", answer) == defect


def test_broken_answers_table(spark):
    df = spark.createDataFrame([(1, "Where is it?", None, 2.0, "x"), (1, "Where is it?", None, None, "x"), (2, None, "Fine words that end well.", 0.5, "y"), (None, "Q", "", None, None)], "answer_id long, question string, answer string, confidence double, defect string")
    assert sorted((r.answer_id or 0, r.defect) for r in broken_answers(df).collect()) == [(0, "empty"), (1, "empty"), (1, "empty")]
    assert broken_answers(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 300), st.integers(2, 40), st.integers(0, 10), st.randoms(use_true_random=False))
def test_pieces_cover_and_overlap(n, limit, overlap, rnd):
    overlap = min(overlap, limit - 1)
    text = "".join(rnd.choice(["word", "end.", "x,"]) + rnd.choice([" ", "\n", "\n\n", "\t"]) for _ in range(n))
    starts, ends, pen = boundaries(text)
    assert len(starts) == n
    at, prev = 0, None
    for e in cut_points(pen, limit, overlap):
        assert 0 < e - at <= limit and (prev is None or prev - at == overlap)
        prev, at = e, e - overlap
    assert prev == (n or None)


def test_cut_prefers_boundaries():
    text = "a b c d e.\n\nf g h i j k l"
    _, _, pen = boundaries(text)
    assert cut_points(pen, 8, 0) == [5, 12]
    assert boundaries("see Fig. 3 now. Then go")[2][1] > boundaries("see Fig. 3 now. Then go")[2][3]


def test_split_table(spark):
    long = " ".join(f"t{i}" for i in range(2500))
    df = spark.createDataFrame([("a", long, 1), ("a", long, 1), ("b", "short", 2), ("c", None, 3), ("d", " \n ", 4), (None, long, 5)], "id string, text string, piece_no int")
    rows = split_oversized(df, 1000, 150).collect()
    a = sorted((r for r in rows if r.id == "a"), key=lambda r: r.piece_no)
    assert {r.id for r in rows} == {"a", None} and a[0].start_token == 0 and a[-1].end_token == 2500
    assert all(x.end_token - y.start_token == 150 for x, y in zip(a, a[1:])) and all(r.text.split() == long.split()[r.start_token : r.end_token] for r in a)
    assert split_oversized(df.limit(0), 10, 2).count() == 0
    two = " ".join(["z"] * 1800)
    both = split_oversized(spark.createDataFrame([("a", long), ("a", two), ("v", "\v".join(["x"] * 2000)), ("w", " ".join("\v" for _ in range(1200)))], "id string, text string"), 1000, 150).collect()
    assert {r.text.split(" ")[0] for r in both if r.id == "a"} == {"z"} and max(r.end_token for r in both if r.id == "a") == 1800 and {r.id for r in both} == {"a", "w"}
    with pytest.raises(ValueError):
        split_oversized(df, 5, 5)


def test_hilbert_is_a_curve():
    grid = np.array(list(itertools.product(range(8), repeat=3)))
    order = grid[np.argsort(hilbert_keys(grid, 3))]
    assert len(set(hilbert_keys(grid, 3))) == 512 and (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 16))
    x = np.repeat(centres, 4, 0) + 0.05 * rng.standard_normal((240, 16))
    x[1] = x[0]
    x[2] = x[0]
    rows = [(f"v{i:03d}", i, [float(y) for y in v], "z") for i, v in enumerate(x)]
    rows += [("v000", -1, [1.0] * 16, "old"), ("bad", 1, None, ""), ("short", 1, [1.0], ""), ("zero", 1, [0.0] * 16, ""), ("nan", 1, [float("nan")] * 16, ""), (None, 1, [1.0] * 16, "")]
    u = usable(spark.createDataFrame(rows, "chunk_id string, row_id long, embedding array<float>, cosine string"), "chunk_id", "row_id", width=16)
    assert u.count() == 240
    got = {(r.id, r.other) for r in nearest(u, 5, 0.85, 16).collect()}
    g = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = g @ g.T
    np.fill_diagonal(s, -2)
    want = {(f"v{i:03d}", f"v{j:03d}") for i in range(240) for j in np.argsort(-s[i], kind="stable")[:5] if s[i, j] >= 0.85}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    q = nearest(u, 5, -1.0, 16, queries=u.where("id = 'v010'").select("id")).collect()
    assert len(q) == 5 and all(r.id == "v010" for r in q)
    assert nearest(u.limit(0), 5, -1.0, 16).count() == 0


def _recall(spark, x, floor, recall, queries=None, width=64, copies=0):
    rows = [(f"v{i:05d}", [float(y) for y in v]) for i, v in enumerate(x)]
    u = spark.createDataFrame(rows, "id string, unit array<float>").repartition(4)
    asked = None if queries is None else spark.createDataFrame([(f"v{i:05d}",) for i in queries], "id string")
    got = {(r.id, r.other) for r in nearest(u, 5, floor, width, recall, asked).collect()}
    check = range(0, len(x), 17) if queries is None else queries
    want = set()
    for i in check:
        s = x @ x[i]
        s[i] = -2
        want |= {(f"v{i:05d}", f"v{j:05d}") for j in np.argsort(-s, kind="stable")[:5] if s[j] >= floor}
    return len(got & want) / len(want), {a for a, _ in got}


def test_nearest_recall_without_floor(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((8000, 64)) + np.repeat(rng.standard_normal((400, 64)), 20, 0)  # hardly any structure
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    assert _recall(spark, x, -1.0, 0.95)[0] >= 0.9
    asked = list(range(0, 8000, 160))
    share, ids = _recall(spark, x, -1.0, 0.97, asked)
    assert share >= 0.9 and ids == {f"v{i:05d}" for i in asked}


def test_nearest_with_a_third_in_one_place(spark, monkeypatch):
    import manuscope.llm.neighbours as m

    monkeypatch.setattr(m, "RANGE", 300)  # windows reach over many ranges
    rng = np.random.default_rng(9)
    x = rng.standard_normal((3000, 64))
    x[::3] = x[0] + 1e-4 * rng.standard_normal((1000, 64))  # one cell of every curve
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    places, _ = m.fit(spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "class long, unit array<float>"), 3000, 5, -1.0, 0.9, 64)
    pos = places.of(0, m.keys_of(x)[0], np.arange(3000)) * 3000
    assert np.bincount((pos // 300).astype(int)).max() < 450
    assert _recall(spark, x[1::3], -1.0, 0.97)[0] >= 0.9


def test_usable_vectors(spark):
    rows = [("a", 1, [3.0, 4.0]), ("a", 2, [1.0, None]), ("b", 1, [1e30, 0.0]), ("c", 1, [float("inf"), 1.0]), ("d", 1, None), ("e", None, [0.0, 2.0]), (None, 3, [1.0, 1.0]), ("f", 1, [0.0, 0.0]), ("g", 1, [1e-30, 0.0])]
    u = usable(spark.createDataFrame(rows, "k string, version long, embedding array<float>"), "k", "version", width=2)
    assert {r.id: [round(v, 4) for v in r.unit] for r in u.collect()} == {"a": [0.6, 0.8], "b": [1.0, 0.0], "e": [0.0, 1.0], "g": [1.0, 0.0]}


def test_shared_spans_against_brute_force(spark):
    rnd = random.Random(7)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(900))
    rows = []
    for i in range(24):
        a, n = rnd.randrange(500), rnd.choice([120, 199, 200, 260, 380])
        noise = lambda: "".join(rnd.choice("ijklmnop ") for _ in range(rnd.randint(0, 300)))
        rows.append((i % 2, f"r{i:02d}", noise() + base[a : a + n] + noise(), 0, ""))
    rows += [rows[0], (0, "n", None, 0, ""), (0, "e", "", 0, ""), (0, None, base, 0, ""), (0, "self", base[:0] + "q" * 900, 0, "")]
    spans, shares = shared_spans(spark.createDataFrame(rows, RECORDS), 200)
    text = {(a, b): t for a, b, t, *_ in rows if b and t}
    want = {}
    for k, t in text.items():
        mark = [False] * len(t)
        for i in range(len(t) - 199):
            if any(o != k and o[0] == k[0] and t[i : i + 200] in u for o, u in text.items()):
                mark[i : i + 200] = [True] * 200
        if any(mark):
            want[k] = sum(mark)
    assert {(r.rec_table, r.rec_id): r.shared_chars for r in shares.collect()} == want and want
    assert {(r.rec_table, r.rec_id) for r in spans.collect()} == set(want)
    left = {(r.rec_table, r.rec_id): r.text for r in without_spans(spark.createDataFrame(rows, RECORDS), spans).collect()}
    assert set(left) == {(a, b) for a, b, *_ in rows if b} and left[0, "n"] is None
    assert all(len(left[k]) == len(t) - want.get(k, 0) for k, t in text.items()) and all(left[k] == t for k, t in text.items() if k not in want)
    assert shared_spans(spark.createDataFrame([], RECORDS), 200)[1].count() == 0


def test_shared_spans_hot_anchor(spark, monkeypatch):
    import manuscope.llm.shared_spans as m

    monkeypatch.setattr(m, "HOT_BODIES", 1)
    rnd = random.Random(9)
    common = "".join(rnd.choice("abcdefgh ") for _ in range(210))
    rows = [(0, f"r{i}", "".join(rnd.choice("ijklmnop ") for _ in range(200)) + common + "".join(rnd.choice("qrstuvwx ") for _ in range(200)), 0, "") for i in range(6)]
    got = [r.shared_chars for r in shared_spans(spark.createDataFrame(rows, RECORDS), 200)[1].collect()]
    assert len(got) == 6 and all(210 <= x <= 220 for x in got)  # the texts around may agree in a few characters


def test_share_of_every_record(spark, tmp_path):
    from manuscope.llm.queries import p7_share

    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    common, alone = text(250), text(400)
    rows = [("a", common), ("b", common), ("b", common), ("alone", alone), ("short", "few words"), ("null", None), ("empty", ""), (None, common)]
    spark.createDataFrame(rows, "id string, text string").write.parquet(str(tmp_path / "who_chunks_semantic.parquet"))
    spark.createDataFrame([("a", common)], "chunk_id string, text string").write.parquet(str(tmp_path / "nodes_text.parquet"))
    got = {(r.rec_table, r.rec_id): (r.chars, r.shared_chars, r.share) for r in p7_share(spark, str(tmp_path)).collect()}
    want = {"a": (250, 250, 1.0), "b": (250, 250, 1.0), "alone": (400, 0, 0.0), "short": (9, 0, 0.0), "null": (0, 0, 0.0), "empty": (0, 0, 0.0)}
    assert got == {("who_chunks_semantic", k): v for k, v in want.items()} | {("nodes_text", "a"): (250, 0, 0.0)}


def test_anchor_in_every_span():
    t = "".join(random.Random(1).choice("abc d") for _ in range(3000))
    _, at, h = anchors([t], 200)
    for i in range(0, 2800, 7):
        assert any(i <= p <= i + 100 for p in at)
    assert shared_in(["x" * 250, "y" + "x" * 250], [1, 2], 200)[0] == [(0, 250)]


@pytest.mark.parametrize("segments,loss", [(64, 1.0), (3, 1.0), (64, 0.5)])
def test_packing_keeps_limits(spark, segments, loss):
    rnd = random.Random(2)
    rows = [(i, rnd.choice([5, 17, 100, 300, 900]), rnd.choice([None, 3, 50]), "x") for i in range(400)] + [(400, None, None, ""), (401, 0, 0, ""), (3, 7, 7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, tokens int, loss_tokens int, container string")
    out = pack(df, 512, segments, loss).toPandas()
    by = out.groupby("container").agg(t=("tokens", "sum"), n=("tokens", "size"), l=("loss_tokens", "sum"))
    assert by.t.max() <= 512 and by.n.max() <= segments and by.l.max() <= 512 * loss
    assert out.tokens.sum() == sum(r[1] or 0 for r in rows)
    assert all(len(g) == 1 for d, g in out.groupby("doc_id") if d != 3 and rows[int(d)][1] <= 512 * (loss if rows[int(d)][2] else 1))
    assert pack(df.limit(0), 512).count() == 0


def test_packing_queries_keep_a_binding_loss_limit(spark):
    from manuscope.llm import queries as q

    d = "/root/testdata/sf0.001"
    cap = {k: v[0] for k, v in q.limits(spark, d).items()}
    boxes = q.p8_pack(spark, d).groupBy("limit_name", "container").agg({"tokens": "sum", "loss_tokens": "sum"}).collect()
    assert boxes and all(r["sum(loss_tokens)"] <= int(0.9 * cap[r.limit_name]) for r in boxes)
    fill = {r.limit_name: r for r in q.p8_fill(spark, d).collect()}
    assert all(r.most_loss <= r.loss_limit < cap[k] for k, r in fill.items()) and fill["pack_small"].at_loss_limit > 0
    assert all(r.tokens == q._sized(spark, d).agg({"tokens": "sum"}).first()[0] for r in fill.values())


def test_pack_block_fills_exactly():
    box = pack_block(np.array([6, 4, 5, 5, 3, 7]), np.zeros(6, int), 10, 9, 10)
    assert len(set(box)) == 3
    sizes = np.random.default_rng(4).integers(10, 300, 3000)
    box = pack_block(sizes, sizes, 512, 64, 512)
    assert sizes.sum() / (512 * len(set(box))) > 0.985


def test_mixing(spark):
    rows = [(i, ["big", " Big ", "small", None][i % 4], 100, 1.0 if i % 3 else None, 7) for i in range(4000)] + [(9000, "big", 0, 1.0, 1), (None, "big", 5, 1.0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens int, weight double, slice int")
    t = spark.createDataFrame([("big", 0.9, 1), ("small", 0.09, 3), ("absent", 0.01, 2)], "source string, target_share double, max_repeats int")
    m, s = mix(df, t, total=110_000)
    share = {r.source: r for r in s.collect()}
    assert abs(share["big"].taken_tokens - 99_000) <= 100 and abs(share["small"].taken_tokens - 9_900) <= 100 and share["absent"].taken_tokens == 0
    assert m.agg({"uses": "max"}).first()[0] == 1 and m.select("doc_id").distinct().count() == m.count()
    over = {r.source: r for r in mix(df, t, total=10_000_000)[1].collect()}
    assert over["small"].taken_tokens == 3 * over["small"].available_tokens and over["big"].taken_tokens == over["big"].available_tokens
    half = {r.source: r for r in mix(df, t, total=2_800_000)[1].collect()}["small"]
    assert abs(half.taken_tokens - 252_000) <= 100  # two whole epochs and a part of the third
    assert mix(df.limit(0), t)[0].count() == 0 and mix(df.limit(0), t)[1].count() == 3


@pytest.mark.parametrize(
    "text,kind",
    [
        (None, None), ("", None), ("Copy issued to {{lab_name}} today. The tray stays on the shelf.", "placeholder"), ("Lab name: ________\nDate: TODO", "placeholder"), ("Keep it at <INSERT FLOOR> now.", "placeholder"),
        ("See [Table 3] and {1, 2} for the order. The tray stays here.", None), ("Write TODO on the board of bench 9 for open tasks.", None), ("The analyser shows error 404 when lid 2 is open. Keep the tray shut.", None),
        ("404 Not Found\nThe page you asked for is no longer on this server.\nRef. 3", "error"), ('{"status": 404, "error": "not_found"}', "error"),
        ("Please enable JavaScript to read this manual.", "script"), ("The stock program needs JavaScript on terminal 2; the safe is shut and the tray is on the shelf in the store.", None),
        ("Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "filler"), ("Cold chain\n...\n\nHandling\n—", "filler"), ("asdf xxx qwer jkl foo", "filler"),
    ],
)
def test_residue(text, kind):
    assert Detector().residue(text) == kind


#: Real content of other languages and kinds, none of it residue.
CONTENT = {
    'pl': 'Laboratorium powinno przechowywać wszystkie próbki w zamkniętej lodówce, a temperatura musi być sprawdzana codziennie rano. Jeśli drzwi pozostają otwarte dłużej niż pięć minut, należy powiadomić kierownika zmiany i zapisać zdarzenie w dzienniku. Po zakończeniu pracy trzeba umyć blaty, wynieść odpady oraz zamknąć szafę bezpieczeństwa.',
    'it': "Il laboratorio deve conservare tutti i campioni in un frigorifero chiuso e la temperatura va controllata ogni mattina. Se la porta rimane aperta per più di cinque minuti, bisogna avvisare il responsabile del turno e registrare l'evento nel diario. Alla fine del lavoro si lavano i banchi, si portano fuori i rifiuti e si chiude la cappa.",
    'pt': 'O laboratório deve guardar todas as amostras num frigorífico fechado e a temperatura tem de ser verificada todas as manhãs. Se a porta ficar aberta mais de cinco minutos, avise o chefe de turno e registe o caso no livro. No fim do trabalho lavam-se as bancadas, levam-se os resíduos e fecha-se a câmara.',
    'fi': 'Laboratorion on säilytettävä kaikki näytteet suljetussa jääkaapissa ja lämpötila on tarkistettava joka aamu. Jos ovi on auki yli viisi minuuttia, ilmoita vuoron esimiehelle ja kirjaa tapahtuma päiväkirjaan. Työn jälkeen pöydät pestään, jätteet viedään ulos ja turvakaappi suljetaan huolellisesti.',
    'tr': 'Laboratuvar bütün numuneleri kapalı bir buzdolabında saklamalı ve sıcaklık her sabah kontrol edilmelidir. Kapı beş dakikadan uzun süre açık kalırsa vardiya sorumlusuna haber verin ve olayı deftere yazın. İş bitince tezgahlar yıkanır, atıklar dışarı çıkarılır ve güvenlik dolabı kapatılır.',
    'la': 'Gallia est omnis divisa in partes tres, quarum unam incolunt Belgae, aliam Aquitani, tertiam qui ipsorum lingua Celtae, nostra Galli appellantur. Hi omnes lingua, institutis, legibus inter se differunt. Gallos ab Aquitanis Garumna flumen, a Belgis Matrona et Sequana dividit. Horum omnium fortissimi sunt Belgae.',
    'sw': 'Maabara inapaswa kuhifadhi sampuli zote katika jokofu lililofungwa na halijoto ikaguliwe kila asubuhi. Mlango ukibaki wazi kwa zaidi ya dakika tano, mjulishe msimamizi wa zamu na uandike tukio hilo kwenye kitabu. Baada ya kazi meza zinaoshwa, taka zinatolewa nje na kabati la usalama linafungwa.',
    'ru': 'Лаборатория должна хранить все образцы в закрытом холодильнике, а температуру нужно проверять каждое утро. Если дверь открыта дольше пяти минут, сообщите начальнику смены и запишите случай в журнал. После работы столы моют, отходы выносят, а шкаф безопасности закрывают.',
    'vi': 'Phòng thí nghiệm phải giữ tất cả các mẫu trong tủ lạnh đóng kín và nhiệt độ phải được kiểm tra mỗi buổi sáng. Nếu cửa mở lâu hơn năm phút, hãy báo cho trưởng ca và ghi sự việc vào sổ. Sau khi làm việc phải rửa bàn, mang rác ra ngoài và đóng tủ an toàn.',
    'id': 'Laboratorium harus menyimpan semua sampel di dalam kulkas tertutup dan suhu harus diperiksa setiap pagi. Jika pintu terbuka lebih dari lima menit, beri tahu kepala regu dan catat kejadian itu di buku harian. Setelah pekerjaan selesai meja dicuci, sampah dibuang dan lemari pengaman ditutup.',
    'inv': 'Beaker 250 ml 12 pcs\nPipette tips 200 ul 40 boxes\nGloves nitrile M 18 packs\nCentrifuge tubes 15 ml 300 pcs\nEthanol 96 % 25 l\nPetri dishes 90 mm 500 pcs\nParafilm 3 rolls\nCryovials 2 ml 250 pcs\nAutoclave bags large 60 pcs',
    'py': "import os\n\nclass Reader:\n    def __init__(self, path):\n        self.path = path\n\n    def __repr__(self):\n        return f'Reader({self.path})'\n\n    def rows(self):\n        with open(self.path) as f:\n            for line in f:\n                yield line.rstrip().split(',')\n\nif __name__ == '__main__':\n    print(list(Reader('data.csv').rows()))",
    'sh': 'The variable ${HOME} holds the path of your home directory. To add a folder to the search path, write export PATH=${HOME}/bin:${PATH} into the profile file. After that every program in the folder can be started by name.',
    'jinja': 'A Jinja template is a text with tags. The engine replaces {{ name }} by the value of the variable and {% if user %} opens a block that ends with {% endif %}. Filters are written with a bar after the name of the variable.',
    'dunder': 'Python calls __init__ when an object is made, and __repr__ when it is shown. A module that is run by itself has the name __main__ and imports of it keep their own.',
    'icu': 'Patients in the intensive care unit [ICU] were seen every morning by the team. The ward lead checked the pumps and wrote the values into the chart.',
    'key': 'Press <KEY> to go on, or <ESC> to leave the menu. The display shows the last value until the lid is opened again.',
    'make': 'The makefile uses $(CC) as the compiler and $(CFLAGS) for its options. Run make again after the headers have been changed.',
    'es«»': 'El manual llama «vitrina» a la cabina y «bata» a la ropa de trabajo. En cada puesto hay una lista con los nombres que usa el equipo.',
    'wiki': 'The cell was named by [[Robert Hooke]] in 1665, who looked at cork under a [[microscope]] and saw rows of small rooms.',
    'pinyin': 'Qing ba suo you yang pin fang zai bing xiang li, mei tian zao shang jian cha wen du. Ru guo men kai zhe chao guo wu fen zhong, qing tong zhi ban zhang bing qie ji lu zai ben zi shang.',
    'err': 'When the viewer shows the message access denied, ask the unit lead for a new card. The door stays shut until the card has been read, and the event is written into the log of the day.',
}
NOTICES = {
    'den': 'Access to this resource on the server is denied!',
    'cap': 'Please verify you are human. Complete the CAPTCHA below to continue.',
    'cook': 'Cookies are disabled in your browser. Please enable cookies to continue.',
    'it404': 'Pagina non trovata. La pagina richiesta non esiste.',
    'pl404': 'Nie znaleziono strony. Strona, której szukasz, nie istnieje.',
    'zh404': '页面不存在。您访问的页面已被删除。',
    'ja404': 'ページが見つかりません。お探しのページは削除された可能性があります。',
    'itjs': 'Per favore abilita JavaScript per continuare.',
    'pljs': 'Włącz JavaScript, aby wyświetlić tę stronę.',
    'jajs': 'このサイトを利用するにはJavaScriptを有効にしてください。',
    'zhjs': '请启用JavaScript以继续访问。',
    'lorem': 'Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.',
}


@pytest.mark.parametrize("name", CONTENT)
def test_content_is_no_residue(name):
    assert Detector().residue(CONTENT[name]) is None


@pytest.mark.parametrize("name", NOTICES)
def test_notices_of_many_languages(name):
    assert Detector().residue(NOTICES[name]) is not None


def test_residue_learns_from_all_documents(spark):
    rnd = random.Random(6)
    mock = "lorem grundel pastik vomer halquin tresk ipsum orfel".split()
    parts = "bra kol tem vus nar gil dop fex hum jat lir mok".split()
    made = lambda n: " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    rows = [(i, " ".join(rnd.choice(mock) for _ in range(40)) + ".") for i in range(30)] + [(100 + i, made(60)) for i in range(20)]
    rows += [(200, "Grundel pastik vomer halquin tresk orfel."), (201, made(16)), (202, "Hand the form to [OFFICER] at the gate."), (203, "Valid for {officer} until Monday."), (204, "Hand the form to [ICU] at the gate.")]
    rows += [(300 + i, t) for i, t in enumerate(CONTENT.values())] + [(400, None), (401, " "), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.kind for r in template_residue(df).collect()}
    assert {i for i, k in got.items() if k == "filler"} == {None, *range(30), *range(100, 120), 200, 201}
    assert {i for i, k in got.items() if k == "placeholder"} == {202, 203} and len(got) == 55
    assert template_residue(df.where("doc_id = 400")).count() == 0 and template_residue(df.limit(0)).count() == 0


def test_residue_table(spark):
    df = spark.createDataFrame([(1, "Lorem ipsum dolor sit amet", "a"), (2, "The tray is kept on the shelf.", "b"), (None, None, None), (1, "Lorem ipsum dolor sit amet", "a")], "doc_id long, text string, kind string")
    assert [r.doc_id for r in template_residue(df).collect()] == [1, 1]
    assert sorted(r.doc_id or 0 for r in without_residue(df).collect()) == [0, 2]


def test_furniture():
    lines = furniture("Guide to Bench Work\nBody text goes on here\n- 12 -\nGuide to Bnch Work — Storage | 7\nNumber\nTrays\n12\nLids\n40\nxxxv\n", Titles(["Guide to Bench Work"]))
    assert [(x.header, x.number) for x in lines[:4]] == [(True, False), (False, False), (False, True), (True, True)]
    assert [x.number for x in lines[4:]] == [False, False, False, False, False, True, False]
    assert not any(x.header for x in furniture("See the Guide to Bench Work for the other steps of this.", Titles(["Guide to Bench Work"])))


def test_reflow():
    assert reflow(["One line", "goes on", "here.", "", "Next", "* item", "* item two"]) == "One line goes on here.\n\nNext\n* item\n* item two"


def test_scan_noise(spark):
    body = "The trained operator should record the number of the sealed container under the second shelf before the next shift. Keep the water-bath at 40 units near the bench and close the drum. "
    rows = [(0, f"g{i}", "M", body * 3, "k") for i in range(40)]
    noisy = "The trained operator shou1d record the num-\n\nBench Guide\n17\n\nber of the sealed contaiiner uncler the second shelf. Keep the water-\nbath at 4O units near the bench."
    rows += [(0, "n", "M", noisy, "k"), (0, "z", None, None, None), (0, "b", "M", "  ", None), (1, "n", None, "Code B70, grade 1Ox, batch L077-16I.", "k")]
    df = spark.createDataFrame(rows, "rec_table int, rec_id string, manual string, text string, kinds string")
    m = spark.createDataFrame([("M", "Bench Guide", 1)], "manual string, title string, edition int")
    out = {(r.rec_table, r.rec_id): r for r in read_scans(df, m).collect()}
    assert set(out[0, "n"].kinds) == {"misread", "broken_word", "header", "page_number"}
    assert "should record the number of" in out[0, "n"].text and "under the second shelf" in out[0, "n"].text and "water-bath" in out[0, "n"].text
    assert out[0, "g1"].kinds == [] and out[0, "z"].text is None and out[0, "b"].text == "" and out[1, "n"].kinds == []
    assert read_scans(df.limit(0), m).count() == 0


def test_scan_vectors_decide(spark):
    """A sound rare word that one glyph edit turns into a frequent one stays where that one doesn't fit."""
    rnd = random.Random(2)
    places = ["turn left at the {} of the long hall", "meet us by the {} of the main street", "the shop at the {} sells fresh bread"]
    other = ["a late {} may still win the open race", "each late {} must sign the open list", "no late {} gets in after the open bell"]
    texts = [rnd.choice(places).format("corner") for _ in range(150)] + [rnd.choice(other).format("runner") for _ in range(150)]
    rows = [(0, f"g{i}", None, t, "k") for i, t in enumerate(texts)] + [(0, "sound", None, other[0].format("comer"), "k"), (0, "noise", None, places[0].format("comer"), "k"), (0, "alone", None, "comer", "k"), (0, "digit", None, "c0rner", "k")]
    df = spark.createDataFrame(rows, "rec_table int, rec_id string, manual string, text string, kinds string")
    out = {r.rec_id: r for r in read_scans(df, spark.createDataFrame([], "manual string, title string")).collect()}
    assert out["noise"].kinds == ["misread"] and "corner" in out["noise"].text and out["digit"].text == "corner"
    assert out["sound"].kinds == [] and out["alone"].kinds == []


def test_long_furniture():
    title = "Handbook of the Storage and the Handling of Fragile Instruments in Small Laboratories of Remote Districts and Islands"
    assert furniture(f"  {title}  |  Chapter on the cleaning of tubes | 117", Titles([title]))[0][1:] == (True, True)
    assert furniture("Guide to Bench Work.", Titles(["Guide to Bench Work"]))[0].header and not furniture("12.", Titles([]))[0].number
    word = "x" * 80
    assert furniture("- - - - - 12 - - - - - - - - - -", Titles([]))[0].number and word


def test_scan_vocabulary_has_no_rank_cut(spark, monkeypatch):
    import manuscope.llm.scan_noise as m

    rnd = random.Random(4)
    df = spark.createDataFrame([(" ".join(f"w{min(rnd.randrange(60), rnd.randrange(60))}x" for _ in range(50)),) for _ in range(40)], "text string")
    words, counts, vectors, contexts = m.learn(df)[:4]
    monkeypatch.setattr(m, "BLOCK", 7, raising=False)
    monkeypatch.setattr(m, "VOCABULARY", 7, raising=False)
    again = m.learn(df)
    true = {w: n for w, n in Counter(" ".join(r.text for r in df.collect()).split()).items() if n >= m.LEAST_COUNT}
    assert dict(zip(again[0], again[1])) == true and len(true) > 50 and again[0] == words
    assert np.allclose(vectors @ vectors.T, again[2] @ again[2].T, rtol=1e-3, atol=1e-3) and np.allclose(vectors @ contexts.T, again[2] @ again[3].T, rtol=1e-3, atol=1e-3)


def test_scan_noise_counts_rare_words(spark):
    text = "The trained operator should note the {} on the second shelf before the next shift."
    rows = [(0, f"{w}{i}", "M", text.format(w), "k") for w, n in (("comer", 20), ("corner", 4), ("tumer", 20), ("turner", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "rec_table int, rec_id string, manual string, text string, kinds string")
    out = {r.rec_id: r for r in read_scans(df, spark.createDataFrame([("M", "Bench Guide")], "manual string, title string")).collect()}
    assert all(out[f"corner{i}"].kinds == [] and "corner" in out[f"corner{i}"].text for i in range(4))  # 20 uses are not 8 times 4
    assert out["turner0"].kinds == ["misread"] and "tumer" in out["turner0"].text
