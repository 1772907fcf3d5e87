"""Operators on documents: odd rows against brute force."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from nameprice.llm import (bpe_tree, chunk_dedup, frames, histogram_sort, langid, odd_sketch, pfair,
                           pii_crf)
from nameprice.llm.common import shared_folder

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          # extra columns that clash with names the operators use
          "size long, kept boolean, n long, rep long, shard int, slot long, digest string, ids string")
EXTRA = (9, True, 9, 9, 9, 9, "d", "x")
BASE = " ".join(f"w{i}" for i in range(120))


def odd_rows():
    rnd = random.Random(5)
    words = ["alpha", "beta", "gamma delta", "the", "of", "über", "ñandú", "日本", "x1", "42"]
    long = " ".join(rnd.choice(words) for _ in range(60_000))
    near = BASE.replace("w60", "changed")
    texts = [(1, None), (2, ""), (3, " \t\n "), (4, long), (5, "same text here"),
             (6, "same \t text\nhere"), (6, "same \t text\nhere"), (None, "same text here"),
             (None, "only null id"), (None, "only null id"), (7, BASE), (8, near), (9, near.upper()),
             (10, "a" * 5000), (11, long + " tail"), (12, "one two"), (13, "One  two"),
             (14, "1234 5678"), (15, "mail a.b@c.example.com, +1 (017) 555-7713, 10.1.2.3 "
                                     "4111 1111 1111 1111 0"), (-3, "minus id"), (2 ** 62, "huge id")]
    return [(i, t, ("en", "de", None)[k % 3], ("s0", "s0", "s1", None)[k % 4], 0, *EXTRA)
            for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def key(row):
    return tuple((v is not None, v if v is not None else 0) if not isinstance(v, str) else v for v in row)


# ---- exact dedup ---------------------------------------------------------------------

@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, weak):
    hashed = (lambda c: F.length(c) % 2) if weak else F.xxhash64
    got = chunk_dedup.exact_dedup(docs, hashed).collect()
    groups = {}
    for i, t in texts_of(docs):
        groups.setdefault(norm(t), []).append(i)
    want = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        first = True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            want.append((i, keep, len(ids), first, hashlib.sha256(t.encode()).hexdigest()))
            first = False
    assert sorted(map(key, want)) == sorted(key(tuple(r)[:5]) for r in got)


def test_chunks_rebuild_the_text_and_survive_an_insertion(spark):
    rnd = random.Random(1)
    text = " ".join("".join(rnd.choice("aeionrstw") for _ in range(5)) for _ in range(8000))
    rows = [(text,), (text[:9000] + "inserted words " + text[9000:],), ("x" * 30_000,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(
        chunk_dedup.chunks(F.col("t"))).collect()]
    assert ["".join(c) for c in got] == [r[0] for r in rows]
    shared = len(set(got[0]) & set(got[1]))
    assert shared >= len(got[0]) // 2 and max(map(len, got[2])) <= chunk_dedup.MAX_CHUNK


def test_drop_copies_keeps_columns_and_one_row_per_text(docs):
    out = chunk_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    kept = [norm(r["text"]) for r in out.collect()]
    assert sorted(kept) == sorted({norm(t) for _, t in texts_of(docs)})


# ---- language ------------------------------------------------------------------------

def test_language(spark):
    rnd = random.Random(2)
    stems = {"en": ["the", "ing", "tion", "wh", "ou"], "de": ["sch", "ung", "ein", "ü", "tz"],
             "es": ["ción", "mente", "ado", "ñ", "que"]}

    def sentence(lang, n):
        return " ".join("".join(rnd.choices(stems[lang], k=rnd.choice([1, 2, 3]))) for _ in range(n))
    rows = [(i, sentence(lang, rnd.choice([20, 80, 700])), lang)
            for i, lang in enumerate(rnd.choices(sorted(stems), k=360))]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "12 34 ...", "es"), (None, sentence("de", 90), "xx"),
             (1003, sentence("es", 40), None), (1003, sentence("es", 40), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string") \
        .withColumn("score", F.lit("clash")).withColumn("place", F.lit(1))
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    label = {i: lang for i, _, lang in rows}
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {
        i for i, _, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
    judged = [r for r in held if label[r["doc_id"]] and r["doc_id"] < 1000]
    assert sum(r["lang_pred"] == label[r["doc_id"]] for r in judged) >= 0.97 * len(judged)
    by = {r["doc_id"]: r for r in got}
    for i in (1000, 1001, 1002):
        assert (by[i]["lang_pred"], by[i]["score"], by[i]["rejected"]) == ("und", 0.0, True)
    assert {r["lang_pred"] for r in got} <= {*stems, "und"}      # a null id teaches no label
    assert all(0 <= r["score"] <= 1 for r in got)
    # the same as compressing on the driver, and lang or source never matter
    model = langid.compressors(langid.learn(docs))
    for i, t, _ in rows[:60]:
        assert by[i]["lang_pred"] == model.predict(t)[0]
    assert langid.keep_identified(docs).columns == docs.columns


def test_language_without_labels(spark, empty):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert langid.identify(docs).first()["lang_pred"] == "und"
    assert langid.identify(empty).count() == 0


# ---- sharding ------------------------------------------------------------------------

def test_histogram_sort_odd_rows(docs):
    got = histogram_sort.shard_documents(docs, shards=3).collect()
    want = sorted((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
                  for i, t in texts_of(docs))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["size"], r["text_crc32"])
                  for r in got) == want
    for s in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    ids = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in order]
    assert ids == sorted(ids)


def test_histogram_sort_is_even(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice([7, rnd.randrange(-10 ** 15, 10 ** 15)]), f"{k} " + "x" * rnd.randrange(400))
            for k in range(3000)]       # doc_id 7 holds half of the rows
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = histogram_sort.shard_documents(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    sizes = [r["b"] for r in out]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * 410


def test_write_shards_holds_whole_rows(docs):
    path = shared_folder(docs.sparkSession, "shards")
    histogram_sort.write_shards(docs.drop("shard"), path, shards=4)
    back = docs.sparkSession.read.parquet(path)
    assert sorted(map(key, back.select("doc_id", "text").collect())) == sorted(
        key(r) for r in texts_of(docs))


# ---- mixing --------------------------------------------------------------------------

@pytest.mark.parametrize("weights", [[1], [3, 2], [5, 1, 1, 7], [1] * 9, [50, 49, 1], [997, 2, 1]])
def test_period_deviates_less_than_a_block(weights):
    total, done = sum(weights), [0] * len(weights)
    for t, i in enumerate(pfair.period(weights)):
        done[i] += 1
        assert all(abs(n * total - (t + 1) * w) < total for n, w in zip(done, weights))
    assert done == weights


def test_mix_odd_rows(docs):
    got = pfair.mix(docs, {"s0": 2, "s1": 1, None: 1}, block_rows=2).collect()
    assert len(got) == docs.count()
    for s in ("s0", "s1", None):
        own = sorted((r["block"], r["idx"]) for r in got if r["source"] == s)
        assert own == [(k // 2, k % 2) for k in range(len(own))]
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    drawn = {(r["slot"], r["source"]) for r in got if r["in_mix"]}
    assert sorted(s for s, _ in drawn) == list(range(len(drawn)))     # every slot runs once
    assert len({r["source"] for r in pfair.mix(docs, {"s0": 1}).collect()}) == 1
    assert pfair.keep_mix(docs).columns == docs.columns


def test_keep_mix_goes_on_after_a_source_runs_out(spark):
    sizes = {"a": 400, "b": 150, "tiny": 3, None: 2}
    rows = [(None if s is None else i * 1000 + k, f"{s} {k}", s)
            for i, (s, n) in enumerate(sizes.items()) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = [(r["source"], r["text"]) for r in pfair.keep_mix(docs).collect()]
    assert sorted(map(str, got)) == sorted(str((s, t)) for _, t, s in rows)
    names = [None, "a", "b", "tiny"]
    weights = pfair.tempered_weights(sizes)
    blocks = {s: [set(t for _, t in got if t.startswith(f"{s} "))] if s is None else
              [{f"{s} {k}" for k in range(b, min(b + pfair.BLOCK_ROWS, n))}
               for b in range(0, n, pfair.BLOCK_ROWS)] for s, n in sizes.items()}
    at, turns = 0, pfair.period([weights[s] for s in names])
    while any(blocks.values()):
        for i in turns:
            if blocks[names[i]]:                        # one that has run out is passed over
                block = blocks[names[i]].pop(0)
                assert {t for _, t in got[at:at + len(block)]} == block
                at += len(block)
    assert at == len(rows)


# ---- personal data -------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    return {"email": [m.span() for m in EMAIL.finditer(t)],
            "ip": [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))],
            "card": [m.span() for m in CARD.finditer(t)
                     if 16 <= len(digits(m)) <= 19 and pii_crf.luhn(digits(m))],
            "phone": [m.span() for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]}


def test_base_spans_equal_the_plain_patterns():
    rnd = random.Random(4)
    for _ in range(4000):
        t = "".join(rnd.choice("a1.@ -+(5)0,é") for _ in range(rnd.choice([5, 30, 90])))
        assert pii_crf.base_spans(t) == plain_spans(t), t


def _pii_texts():
    rnd = random.Random(6)
    for k in range(120):
        a, b, c, d = (rnd.randrange(10, 99) for _ in range(4))
        yield (f"word na{a}.x@host{b}.example.com and +1 (2{a}) 555-{b}{c} then {a}.{b}.{c}.{d} "
               f"number {a}{b}{c}{d}{a}{b}{c}{d} on 20{a}-0{k % 9 + 1}-1{k % 9}")


def test_crf_adds_what_the_patterns_miss():
    weights = pii_crf.train(list(_pii_texts()))
    report = lambda t: [s for s in pii_crf.report(t, weights)[5].split(",") if s]
    assert report("call (212) 555-7713 now") == ["phone:5:19"]
    assert report("write bob.smith[at]mail3.example.com") == ["email:6:36"]
    assert report("plain words, 12 of them, in 2024 and no more") == []
    assert report("at 2024-01-02 12:33:44 version 1.2.3.4.5")[1:] == []
    t = "a@b.co and (212) 555-7713"
    assert report(t) == ["email:0:6", "phone:11:25"]          # base spans stay


@pytest.mark.parametrize("kind, span", [
    ("email", "john.doe@example.com"), ("email", "a.b@c.d.e.f"), ("email", "x1@y2.org"),
    ("email", "john.doe-smith_b+tag99@mail-3.my-host2.co.uk"), ("ip", "10.1.2.3"),
    ("ip", "1.2.3.4"), ("ip", "192.168.100.200"), ("card", "4111 1111 1111 1111"),
    ("phone", "+1 (212) 555-7713"), ("phone", "+49-30-123-4567")])
@pytest.mark.parametrize("lead, tail", [("", ""), ("write to ", " now"), ("no 12 of (", "), or")])
def test_every_rewrite_is_a_candidate(kind, span, lead, tail):
    assert (0, len(span)) in pii_crf.base_spans(span)[kind]
    new = pii_crf.rewrites(kind, span)
    assert new
    for form in new:
        text, a, b = lead + form + tail, len(lead), len(lead) + len(form)
        inside = [(s, e) for s, e in pii_crf.islands(text) if s <= a and b <= e]
        assert len(inside) == 1, form
        lattice = pii_crf.Lattice(text, *inside[0])
        assert (a, b) in {(lattice.cuts[i], lattice.cuts[j]) for i, j in lattice.at}, form


def test_crf_finds_addresses_with_blanks_and_spelled_out_hosts():
    short = [f"host {k % 9 + 1}.{k % 7}.{k % 5}.{k} is up" for k in range(20)]
    weights = pii_crf.train([*short, *_pii_texts()])
    report = lambda t: [s for s in pii_crf.report(t, weights)[5].split(",") if s]
    assert report("write john.doe @ example.com now") == ["email:6:28"]
    assert report("a.b [at] c [dot] d [dot] e [dot] org") == ["email:0:36"]
    assert report("host 10[.]1[.]2[.]3 is down") == ["ip:5:19"]
    assert report("hello @user how are you, lunch @ noon") == []


def test_segment_search_and_gradient_against_enumeration():
    rnd = np.random.default_rng(1)
    lattice = pii_crf.Lattice("(212) 555-7713 x", 0, 14)
    weights = rnd.normal(size=(len(pii_crf.KINDS), len(pii_crf.FEATURES)))
    scores = lattice.rows @ weights.T

    def ways(i):
        if i == lattice.n:
            yield ()
            return
        yield from ways(i + 1)
        for k, (a, b) in enumerate(lattice.at):
            if a == i:
                for t in range(len(pii_crf.KINDS)):
                    for rest in ways(b):
                        yield ((k, t), *rest)
    every = list(ways(0))
    value = lambda w: sum(scores[k, t] - pii_crf.MIN_SCORE for k, t in w)
    best = max(every, key=value)
    assert [(t, lattice.cuts[lattice.at[k][0]], lattice.cuts[lattice.at[k][1]]) for k, t in best] \
        == lattice.best(weights)
    raw = np.array([sum(scores[k, t] for k, t in w) for w in every])
    share = np.exp(raw - np.logaddexp.reduce(raw))
    gold = [(0, 3)]
    want = np.zeros_like(weights)
    for k, t in gold:
        want[t] += lattice.rows[k]
    for p, w in zip(share, every):
        for k, t in w:
            want[t] -= p * lattice.rows[k]
    assert np.allclose(want, lattice.gradient(weights, gold))


def test_pii_odd_rows(docs, empty):
    got = {}
    for r in pii_crf.find_personal_data(docs).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    for i, t in texts_of(docs):
        spans = plain_spans(t or "")
        listed = ",".join(f"{k}:{a}:{b}" for k in pii_crf.KINDS for a, b in spans[k])
        want = (*(len(spans[k]) for k in pii_crf.KINDS), hashlib.sha256(listed.encode()).hexdigest())
        assert want in [g[:5] for g in got[i]]
    assert sum(map(len, got.values())) == docs.count()
    assert pii_crf.find_personal_data(empty).count() == 0


# ---- token files ---------------------------------------------------------------------

def _tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(frames.TOKENIZER)
    t.encode_special_tokens = True
    return t


def test_frames(docs, empty):
    t = _tokenizer()
    manifest, folder = frames.encode_to_files(docs)
    got = frames.read_documents(docs.sparkSession, manifest, folder).collect()
    want = {}
    for i, text in texts_of(docs):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    back = {}
    for r in got:
        back.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in back.items()} == {k: sorted(v) for k, v in want.items()}
    order = sorted(got, key=lambda r: r["start"])
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in order] == sorted(
        (i is not None, i or 0) for i, _ in texts_of(docs))
    assert [r["start"] for r in order] == [0, *itertools.accumulate(r["n_tokens"] for r in order)][:-1]
    # one document without the others, and the standard reader over the whole file
    name = next(r["file"] for r in got if r["doc_id"] == 7)
    reader = frames.SeekableReader(folder, name)
    assert reader.document(7).tolist() == t.encode(BASE, add_special_tokens=False).ids + [0]
    manifest, folder = frames.encode_to_files(empty)
    assert frames.read_documents(empty.sparkSession, manifest, folder).count() == 0


def test_a_key_that_fills_several_ranges_is_spread_over_them():
    ends = np.array([3, 7, 7, 7, 9])
    spots = [frames.place(ends, 7, c << 24) for c in range(256)]
    assert spots == sorted(spots) and set(spots) == {1, 2, 3, 4}
    every = [(k, c, frames.place(ends, k, c)) for k in range(-1, 12) for c in (0, 1 << 31, (1 << 32) - 1)]
    assert [p for *_, p in every] == sorted(p for *_, p in every)
    assert frames.place(np.zeros(0, dtype=np.int64), 5, 9) == 0


def test_frames_detect_damage(tmp_path):
    import zstandard
    file = frames.SeekableFile(tmp_path.as_uri(), "f.zst")
    parts = [np.arange(k, k + 50, dtype="<u4").tobytes() for k in range(3)]
    for k, p in enumerate(parts):
        file.add(k, zstandard.ZstdCompressor(write_checksum=True).compress(p), len(p),
                 frames.xxhash.xxh64_intdigest(p) & 0xFFFFFFFF)
    file.close()
    data = (tmp_path / "f.zst").read_bytes()
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
                     for _ in range(1))
    assert whole == b"".join(parts)            # plain zstd tools read the file
    (tmp_path / "g.zst").write_bytes(data[:20] + b"\0\0" + data[22:])
    reader = frames.SeekableReader(tmp_path.as_uri(), "g.zst")
    assert reader.frame(2) == parts[2]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        reader.frame(0)


def test_cached_tokenizer_equals_the_library():
    own, t, rnd = frames.tokenizer(frames.TOKENIZER), _tokenizer(), random.Random(8)
    pieces = ["the ", "ab", " \n", "\xa0", "　x", "it's", "日本", "!!", "  ", "\t", "<|endoftext|>", "é"]
    for _ in range(800):
        s = "".join(rnd.choice(pieces) for _ in range(rnd.choice([1, 4, 40])))
        assert np.frombuffer(own.encode(s), "<u4").tolist() == t.encode(s, add_special_tokens=False).ids


# ---- byte-level BPE ------------------------------------------------------------------

def _tiktoken():
    import base64
    import tiktoken
    import public_tokenizers
    with open(bpe_tree.RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={})


def test_tree_encoding_equals_the_library():
    own, library, rnd = bpe_tree.encoder(bpe_tree.RANKS), _tiktoken(), random.Random(9)
    for alphabet in ("ab", "aab ", "abcdefgh", "éèà", "0123456789", "-=_.", " \n\t", "日本語", "aA's"):
        for n in (1, 30, 97, 200, 900):
            s = "".join(rnd.choice(alphabet) for _ in range(n))
            ids = own.encode(s)
            assert ids == library.encode_ordinary(s)
            assert own.decode(ids) == s.encode()
    s = "a" * 20_000
    assert own.encode(s) == library.encode_ordinary(s)


def test_join_is_associative():
    own, rnd = bpe_tree.encoder(bpe_tree.RANKS), random.Random(10)
    for _ in range(300):
        a, b, c = (own.merge(bytes(rnd.choice(b"abct he") for _ in range(rnd.randrange(1, 40))))
                   for _ in range(3))
        left, right = own.join(own.join(a, b), c), own.join(a, own.join(b, c))
        assert left == right == own.merge(own.decode(a + b + c))


def test_bpe_odd_rows(docs, empty):
    library = _tiktoken()
    got = sorted(key(tuple(r)) for r in bpe_tree.digests(docs).collect())
    want = []
    for i, t in texts_of(docs):
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(map(key, want))
    assert all(r["intact"] for r in bpe_tree.encoded(docs).collect())
    ids = docs.select(bpe_tree.ids_of(F.col("text")).alias("i"), "text")
    assert ids.select(bpe_tree.text_of(F.col("i")).alias("b"), "text").where(
        F.col("b") != F.coalesce("text", F.lit("")).cast("binary")).count() == 0
    assert bpe_tree.digests(empty).count() == 0


# ---- near dedup ----------------------------------------------------------------------

def word_set(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4))


def brute_components(rows, threshold):
    """doc_id -> smallest linked id, over rows with ids."""
    sets = [(i, word_set(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x
    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if s and t and 100 * len(s & t) >= threshold * len(s | t):
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return {i: top(i) for i in root}


def test_near_duplicates_odd_rows(docs, empty):
    got = odd_sketch.near_duplicates(docs, 85).collect()
    want = brute_components(texts_of(docs), 85)
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    nulls = {r["component_id"] for r in got if r["doc_id"] is None}
    assert nulls == {5, None}                  # equal to document 5; two rows of their own
    assert odd_sketch.near_duplicates(empty).count() == 0
    assert odd_sketch.drop_near_copies(docs).columns == docs.columns


def test_near_duplicates_of_large_groups(spark, monkeypatch):
    rnd = random.Random(11)
    vocabulary = [f"v{i}" for i in range(4000)]
    rows = []
    for g in range(12):
        base = rnd.choices(vocabulary, k=rnd.choice([12, 60, 300, 1500]))
        for _ in range(rnd.choice([3, 10, 60])):
            words = list(base)
            for _ in range(rnd.randrange(0, max(2, len(base) // 40))):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    passage = " ".join(rnd.choices(vocabulary, k=60))
    rows += [(len(rows) + k, passage + " " + " ".join(rnd.choices(vocabulary, k=60))) for k in range(150)]
    rnd.shuffle(rows)
    monkeypatch.setattr(odd_sketch, "CELL_DOCS", 16)      # buckets of several cells
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for threshold in (80, 85):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
               for r in odd_sketch.near_duplicates(docs, threshold).collect()}
        want = brute_components(rows, threshold)
        assert got == {i: (len(word_set(t)), want[i]) for i, t in rows}


def test_sketch_filter_never_drops_a_link():
    rnd = random.Random(12)
    for _ in range(300):
        n = rnd.choice([8, 40, 300, 700, 3000])
        a = [rnd.getrandbits(64) for _ in range(n)]
        b = a[:]
        for _ in range(rnd.randrange(0, max(2, n // 6))):
            b[rnd.randrange(n)] = rnd.getrandbits(64)
        x, y = (np.unique(np.array(s, dtype=np.uint64)) for s in (a, b))
        if odd_sketch.linked(x, y, 85):
            sketches = np.stack([odd_sketch.odd_sketch(x), odd_sketch.odd_sketch(y)])
            assert len(odd_sketch.partners(sketches, np.array([len(x), len(y)]), 0, 85)) == 1


def test_near_copies_move_texts_in_proportion_to_their_number(spark, monkeypatch):
    rnd = random.Random(17)
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    rows = []
    for i in range(1200):
        words = list(base)
        words[rnd.randrange(300)] = f"n{i}"
        rows.append((i, " ".join(words)))
    # a second cluster that is near the first one, but below the threshold
    far = base[:255] + [f"v{rnd.randrange(5000)}" for _ in range(45)]
    rows += [(2000 + i, " ".join([*far[:i], f"m{i}", *far[i + 1:]])) for i in range(200)]
    moved, real = [], odd_sketch.verified_links
    monkeypatch.setattr(odd_sketch, "CELL_DOCS", 256)
    monkeypatch.setattr(odd_sketch, "verified_links", lambda members, texts, threshold: (
        moved.append(members.count()), real(members, texts, threshold))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in odd_sketch.near_duplicates(docs, 85).collect()}
    assert got == {i: (0 if i < 2000 else 2000) for i, _ in rows}
    assert len(moved) == 3 and sum(moved) < 5 * len(rows)


def test_nearest_pairs_of_components_are_among_those_of_smaller_ones():
    rnd = np.random.default_rng(5)
    sets = [np.unique(np.concatenate([np.arange(200, dtype=np.uint64), rnd.integers(
        1000, 1 << 40, rnd.integers(1, 40)).astype(np.uint64)])) for _ in range(40)]
    sketches = np.stack([odd_sketch.odd_sketch(s) for s in sets])
    n = np.array([len(s) for s in sets])
    fine = rnd.integers(0, 12, 40)
    coarse = fine // 3
    whole, nearest = odd_sketch.across(sketches, n, fine, 85)
    whole_after, nearest_after = odd_sketch.across(sketches, n, coarse, 85)
    assert not (nearest & ~whole).any() and not (nearest_after & ~whole_after).any()
    assert not (nearest_after & ~nearest).any() and not (whole_after & ~whole).any()
    alone, same = odd_sketch.across(sketches, n, np.arange(40), 85)
    assert (alone == same).all() and alone.any()


def test_long_runs_of_equal_halves():
    own, library = bpe_tree.encoder(bpe_tree.RANKS), _tiktoken()
    rnd = random.Random(23)
    for letters in ("a", "ab", "=", "xyz", "\u0434\u0430", "\u7684"):
        for _ in range(40):
            text = letters * rnd.randrange(1, 400)
            assert own.encode(text) == library.encode_ordinary(text)
    run = own.encode("a" * 1_000_000)
    assert own.decode(run) == b"a" * 1_000_000 and len(run) < 300_000
