"""Ranked search, toxicity and vector codes: brute force, held-out accuracy and odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nameprice.llm import hilbert_blocks, kneser_ney, stratified, tokens

DOCS = "doc_id long, text string, item_id string"
TERM = re.compile(tokens.TERM_PATTERN)


def cut(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# ---- terms ---------------------------------------------------------------------------

def test_terms_equal_the_pattern():
    texts = ["Das Öl, 3x", None, "", "a", "--", "ÀB_c　d\x7fe", "x" * 5000 + " Y", "tail", "\nend"]
    found = tokens.terms(pa.array(texts))
    words = found.words.to_pylist()
    got = [[words[i] for i, r in zip(found.ids, found.row) if r == row] for row in range(len(texts))]
    assert got == [cut(t) for t in texts]
    part = pa.array(["skip", *texts]).slice(1)
    assert tokens.terms(part).row.tolist() == found.row.tolist()


# ---- op12 ----------------------------------------------------------------------------

def brute_search(docs, items):
    cuts = [(i, Counter(cut(t))) for i, t in docs]
    cuts = [(i, c) for i, c in cuts if c]
    n_docs, total = len(cuts), sum(sum(c.values()) for _, c in cuts)
    df = Counter(t for _, c in cuts for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(cut(text))
    out = []
    for item, words in wanted.items():
        rows = []
        for i, c in cuts:
            m = 10 + (90 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if t in c)
            if score > 0:
                rows.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2] or 0))[:10])]
    return sorted(out, key=str)


def searched(spark, docs, items):
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], DOCS)
    asked = spark.createDataFrame(items, "item_id long, text string")
    out = stratified.search(stratified.build(df), asked)
    return sorted([tuple(r) for r in out.collect()], key=str)


def test_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ähre", "ß"]
    docs = [(int(i), " ".join(rng.choice(vocabulary, size=rng.integers(1, 60)))) for i in range(150)]
    docs += [(5, docs[5][1]), (None, docs[7][1]), (None, docs[7][1]), (900, None), (901, ""), (902, "!!"),
             (903, "w1 " * 20_000)] + [(1000 + i, "w3 w4 same") for i in range(60)]
    items = [(1, "W1, w2; Ähre"), (2, "w3 w4 same"), (3, "nowhere"), (4, None), (None, "w9 w9"), (6, "w5"), (6, "w6")]
    wanted = brute_search(docs, items)
    assert searched(spark, docs, items) == wanted
    monkeypatch.setattr(stratified, "BLOCK_PAIRS", 3)
    monkeypatch.setattr(stratified, "SEGMENT_POSTINGS", 7)
    monkeypatch.setattr(stratified, "BUFFER", 50)
    assert searched(spark, docs, items) == wanted


def test_a_task_of_the_build_holds_a_bounded_number_of_postings(spark, monkeypatch):
    monkeypatch.setattr(stratified, "TASK_POSTINGS", 100)
    df = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 90}" for k in range(10)), "x") for i in range(400)], DOCS)
    index = stratified.build(df)
    tasks = index.postings(spark).groupBy(F.input_file_name()).agg(F.sum(F.size("docs")).alias("n")).collect()
    assert sum(r["n"] for r in tasks) == 4000
    assert max(r["n"] for r in tasks) <= 400 and len(tasks) > 20


def test_bounds_hold_and_spare_visits():
    queries = stratified.Queries(("a", "b"), np.array([0, 2]), np.array([0, 1]), np.array([5, 7]))
    seg = [stratified.Segment(10 + 40 * k, np.array([0, 0, 1]), np.array([3, 1, 2]), np.array([1, 2, 3, 2]) + 10 * k,
                              np.array([1, 2, 1])) for k in range(3)]
    best = stratified.Best(np.zeros(1, dtype=np.int64))
    for s in seg:
        assert (s.scores(queries.term, queries.weight) <= s.bounds(queries)[0]).all()
    best.least[0] = seg[1].bounds(queries)[0] + 1
    visited = []
    for s in seg:
        s.scores = lambda t, w, s=s: visited.append(s) or stratified.Segment.scores(s, t, w)
    stratified.visit(seg, queries, best)
    assert visited == [seg[0]]


def test_search_of_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, "a")], []) == []


# ---- op11 ----------------------------------------------------------------------------

def tables(spark, rows, labels):
    return (spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, toxic int"),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_bigram_counts_and_lower_order_by_hand(spark):
    rows = [(1, "a b a b", True), (2, "A b c", False), (3, "c", True), (4, None, False), (5, "", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic boolean")
    code = {h: w for w, h in zip("abc", kneser_ney.word_hashes(pa.array(list("abc"))).tolist())} | {kneser_ney.START: "^"}
    got = {(code[r["v"]], code[r["w"]]): (r["toxic"], r["plain"]) for r in kneser_ney.count_bigrams(df).collect()}
    assert got == {("^", "a"): (1, 1), ("a", "b"): (2, 1), ("b", "a"): (1, 0), ("b", "c"): (0, 1), ("^", "c"): (1, 0)}
    sums = kneser_ney._summary(kneser_ney.count_bigrams(df))
    assert (sums["S_t"], sums["S_p"], sums["S"], sums["n_t"], sums["n_p"], sums["W"]) == (4, 3, 5, 5, 3, 3)


def test_model_figures_by_hand(spark):
    """Clear words get their own class figures, all others the shared distribution."""
    rows = [(i, f"x{i} bad y{i} fine", True) for i in range(60)] + [(i, f"x{i} y{i} good fine", False) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic boolean")
    table = kneser_ney.count_bigrams(df)
    model, sums = kneser_ney.learn_model(table), kneser_ney._summary(table)
    words = dict(zip(model.words.tolist(), model.lower.T.tolist()))
    bad, = kneser_ney.word_hashes(pa.array(["bad"])).tolist()
    shared = (60 + 1) / (sums["S"] + sums["W"] + 1)
    toxic = (60 - 0.75) / sums["S_t"] + 0.75 * sums["T_t"] / sums["S_t"] * shared
    plain = 0.75 * sums["T_p"] / sums["S_p"] * shared
    assert np.allclose(words[bad], [toxic, plain])
    found, n = model.evidence(pa.array(["x1 bad", "x1 good fine", "x1 x2", "", None]))
    assert found[0] > 1 > 0 > found[1] and abs(found[2]) < found[0] and n.tolist() == [2, 3, 2, 0, 0]
    assert found[3] == found[4] == 0


def test_held_out_toxicity(spark):
    rng = np.random.default_rng(1)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = list(rng.choice(plain, size=rng.integers(20, 80)))
        if toxic:
            for _ in range(max(1, len(words) // 20)):
                words.insert(int(rng.integers(len(words))), str(rng.choice(["vile", "awful", "nasty"])))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(None, "vile"), (2000, None), (2001, ""), (2002, "..."), (2003, rows[0][1] * 300), (0, rows[0][1])]
    labels += [(None, 1), (3, None), (0, 1), (99999, 1)]
    docs, marked = tables(spark, rows, labels)
    got = kneser_ney.score(docs, marked).collect()
    assert len(got) == len(rows)
    truth = dict(labels[:900])
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got if r["doc_id"] is not None)
    right = [r["predicted"] == truth[r["doc_id"]] for r in held]
    assert len(right) > 100 and np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2000, 2001, 2002)}) == 1


def test_words_beyond_the_arrays_count_all_the_same(spark):
    """More clear words and bigrams than tasks receive: the rest meets the texts in a join."""
    rng = np.random.default_rng(2)
    plain, bad = [f"w{i}" for i in range(40)], [f"bad{i}" for i in range(12)]
    rows, labels = [], []
    for i in range(1500):
        words = list(rng.choice(plain, size=rng.integers(5, 30)))
        if i % 3 == 0:
            at = int(rng.integers(len(words)))
            words[at:at] = [str(w) for w in rng.choice(bad, size=3)] + ["w1", "w2"]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    rows += [(None, "bad1 bad2"), (3000, None), (3001, "bad3"), (0, "w1 w2"), (0, "w1 w2")]
    docs, marked = tables(spark, rows, labels)
    table = kneser_ney.count_bigrams(kneser_ney.training_rows(docs, marked))
    whole = kneser_ney.learn_model(table)
    assert len(whole.pairs) > 5 and len(whole.words) > 5
    assert isinstance(kneser_ney.learn_model(table, 3, 3), kneser_ney.Weights)

    def scores(*most):
        return sorted((str(r["doc_id"]), r["held_out"], round(r["score"], 9), r["predicted"])
                      for r in kneser_ney.score(docs, marked, *most).collect())
    assert len(scores()) == len(rows)
    assert scores(3, 3) == scores() and scores(1 << 17, 3) == scores()


def test_toxicity_without_classes(spark):
    docs, marked = tables(spark, [(1, "a b"), (2, None)], [])
    assert [r["score"] for r in kneser_ney.score(docs, marked).collect()] == [0.0, 0.0]
    docs, marked = tables(spark, [], [(1, 1)])
    assert kneser_ney.score(docs, marked).count() == 0


# ---- op13 ----------------------------------------------------------------------------

def brute_codes(rows):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    X = np.array([v for _, v in kept], dtype=np.int64)
    each = X.shape[1] // 4
    codes, errors, books = [], np.zeros(len(X), dtype=np.int64), []
    for p in range(4):
        part = X[:, p * each:(p + 1) * each]
        book = part[:256].copy()
        for i in range(5):
            away = ((part[:, None] - book[None]) ** 2).sum(2)
            at = away.argmin(1)
            if i < 4:
                for e in np.unique(at):
                    book[e] = part[at == e].sum(0) // (at == e).sum()
        codes.append(at)
        errors += away[np.arange(len(X)), at]
        books.append(book)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()
    return sorted(zip([str(i) for i, _ in kept], ["".join(f"{c[j]:02x}" for c in codes) for j in range(len(X))],
                      errors.tolist())), digest


@pytest.mark.parametrize("scale", [1.0, 3000.0])
def test_codes_equal_brute_force(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(int(i), (scale * rng.normal(size=8)).tolist()) for i in rng.permutation(700)]
    rows += [(3, rows[0][1]), (None, rows[1][1]), (None, rows[1][1]), (800, None), (801, [math.nan] * 8),
             (802, [None] * 8), (803, [math.inf] * 8), (804, [])] + [(900 + i, [0.5] * 8) for i in range(300)]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<double>, codes int")
    coded, books = hilbert_blocks.encode(df)
    got = sorted((str(r["vec_id"]), "".join(f"{c:02x}" for c in r["codes"]), r["error"]) for r in coded.collect())
    wanted, digest = brute_codes(rows)
    assert got == wanted and books.digest() == digest
    assert coded.columns == ["vec_id", "own_codes", "codes", "error"]
    back = coded.select(hilbert_blocks.decode(F.col("codes"), books).alias("v")).first()["v"]
    assert len(back) == 8


def test_few_empty_and_too_large_vectors(spark):
    def table(rows):
        return spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    coded, books = hilbert_blocks.encode(table([(1, [1.0, 2.0, 3.0, 4.0]), (2, [0.0] * 4), (3, [1.0] * 5)]))
    assert {(r["vec_id"], tuple(r["codes"]), r["error"]) for r in coded.collect()} == {(1, (0,) * 4, 0), (2, (1,) * 4, 0)}
    assert hilbert_blocks.encode(table([]))[0].count() == 0
    with pytest.raises(ValueError):
        hilbert_blocks.encode(table([(1, [1e9] * 4)]))


def test_shortlists_never_lose_the_nearest_and_the_curve_keeps_neighbours():
    rng = np.random.default_rng(4)
    points, entries = rng.integers(-50, 50, (400, 6)), rng.integers(-50, 50, (30, 6))
    blocks = points.reshape(20, 20, 6)
    short = hilbert_blocks.shortlists(blocks.min(1), blocks.max(1), entries)
    at, _ = hilbert_blocks.nearest(points, entries, 50)
    assert all(short[i // 20, e] for i, e in enumerate(at))
    grid = np.array([(x, y) for x in range(8) for y in range(8)])
    order = grid[np.argsort(hilbert_blocks.hilbert(grid, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
    assert len(set(hilbert_blocks.hilbert(grid, 3).tolist())) == 64


# ---- cutting of token files ----------------------------------------------------------

def test_columns_are_cut_like_single_texts():
    from nameprice.llm import segments
    rng = np.random.default_rng(6)
    alphabet = list("abcZ é×÷ɏɐß,.'3\t\n 中ー。") + [" ", "　", "  ", "don't", "word,"]
    texts = ["".join(rng.choice(alphabet, size=rng.integers(0, 40))) for _ in range(3000)] + [None, "", " ", "x"]
    found = segments.cut_column(pa.array(texts))
    words, got = found.words.to_pylist(), [[] for _ in texts]
    for i, row in zip(found.ids, found.row):
        got[row].append(words[i])
    assert got == [segments.parts(t) if t else [] for t in texts]
