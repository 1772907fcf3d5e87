"""WARC archives and nearest neighbours on odd rows, against brute force."""

import base64
import hashlib
import random
import zlib
from urllib.parse import unquote

import numpy as np
import pytest
from pyspark.sql import functions as F

from nameprice.llm import kmeans_tree, warc
from nameprice.llm.common import shared_folder

PAGES = "page_id long, url string, html string, key string, copy int, payload string, first long"


def page_rows():
    rows = [(1, "http://a/1", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://a/ü b\r\nx: y", "two"),
            (4, "u", None), (5, "u", ""), (6, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"),
            (None, "n", "only null"), (None, "n", "only null"), (None, "n", "two"), (7, "r", "again"),
            (7, "r", "again"), (7, "other", "again"), (8, "long", "é" * 200_000)]
    return [(*r, "k", 1, "p", 1) for r in rows]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(page_rows(), PAGES).repartition(3)


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_round_trip(pages):
    got = warc.round_trip(pages).where("record_type <> 'warcinfo'").collect()
    assert not [r for r in got if r["kind"] == "gap"]
    assert len(got) == len(page_rows())
    groups = {}
    for i, _, html, *_ in page_rows():
        groups.setdefault(html or "", []).append(i)
    for html, ids in groups.items():
        own = [r for r in got if r["payload_digest"] == b32(html)]
        assert sorted(r["page_id"] or 0 for r in own) == sorted(i or 0 for i in ids)
        assert {r["payload_bytes"] for r in own} == {len(html.encode())}
        response = [r for r in own if r["record_type"] == "response"]
        known = [i for i in ids if i is not None]
        assert [r["page_id"] for r in response] == [min(known) if known else None]
        for r in own:
            if r["record_type"] == "revisit":
                assert r["refers_to"] == (min(known) if known else None)


def test_short_payloads_are_all_responses_and_payloads_come_back(pages):
    folder = shared_folder(pages.sparkSession, "warc")
    manifest = warc.write_archives(pages, folder, min_revisit_bytes=6)
    got = warc.read_archives(manifest, folder, payload=True).where("page_id is not null").collect()
    assert {r["page_id"] for r in got if r["record_type"] == "revisit"} == {2, 4, 5} - {4, 5}
    html = {i: h or "" for i, _, h, *_ in page_rows()}
    for r in got:
        if r["record_type"] == "response":
            assert bytes(r["payload"]).decode() == html[r["page_id"]]
    listed = warc.list_archives(pages.sparkSession, folder)
    assert sorted(r[0] for r in listed.collect()) == sorted(r["file"] for r in manifest.collect())


def test_long_urls_come_back(spark):
    urls = {1: "data:text/html;base64," + "QUJD" * 50_000, 2: "http://h/" + "ü日" * 40_000, 3: "u"}
    rows = [(i, u, "same" if i < 3 else "other", "k", 1, "p", 1) for i, u in urls.items()]
    got = warc.round_trip(spark.createDataFrame(rows, PAGES)).where("record_type <> 'warcinfo' or "
                                                                    "kind = 'gap'").collect()
    assert sorted((r["page_id"], r["kind"], r["record_type"], r["refers_to"]) for r in got) == [
        (1, "record", "response", None), (2, "record", "revisit", 1), (3, "record", "response", None)]
    assert {r["page_id"]: unquote(r["target_uri"]) for r in got} == urls


def test_salvage_of_plain_records_with_long_headers():
    plain = [zlib.decompress(warc.page_record(str(i), "u" * n, b"x", 1, False, None), 31)
             for i, n in enumerate((10, 70_000, 500_000, 20))]
    assert salvaged(b"".join(plain)) == ([0, 1, 2, 3], [])
    cut = plain[2][:300_000]                            # its header block never ends
    ids, gaps = salvaged(plain[0] + cut + plain[1] + cut)
    assert ids == [0, 1]
    assert [(g.offset, g.length) for g in gaps] == [
        (len(plain[0]), 300_000), (len(plain[0] + cut + plain[1]), 300_000)]


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def members(n=8):
    return [warc.page_record(str(i), f"http://h/{i}", f"<html>{i} {'x' * 50 * i}</html>".encode(), 1,
                             False, None) for i in range(n)]


def salvaged(data):
    out = list(warc.salvage(warc.Source.of(data)))
    spans = sorted((x.offset, x.length) for x in out)
    assert sum(n for _, n in spans) == len(data)             # every byte is read or quarantined
    ids = [warc._page_id(x.headers["warc-record-id"]) for x in out if isinstance(x, warc.Record)]
    return ids, [x for x in out if isinstance(x, warc.Gap)]


def test_salvage_of_whole_archives():
    assert salvaged(b"".join(members())) == (list(range(8)), [])
    assert salvaged(b"") == ([], [])


@pytest.mark.parametrize("damage", ["flip", "cut start", "cut end", "junk between", "zeros", "magic in junk"])
def test_salvage_goes_on_after_damage(damage):
    parts = members()
    at = sum(map(len, parts[:3]))
    data = b"".join(parts)
    if damage == "flip":
        data = data[:at + 60] + bytes([data[at + 60] ^ 0xFF]) + data[at + 61:]
        lost, gap = {3}, (at, len(parts[3]))
    elif damage == "cut start":
        data = data[at + 5:]
        lost, gap = {0, 1, 2, 3}, (0, len(parts[3]) - 5)
    elif damage == "cut end":
        data = data[:at + 20]
        lost, gap = {3, 4, 5, 6, 7}, (at, 20)
    elif damage == "junk between":
        data = data[:at] + b"junk" * 100 + data[at:]
        lost, gap = set(), (at, 400)
    elif damage == "zeros":
        data = data[:at] + bytes(len(parts[3]) + len(parts[4])) + data[at + len(parts[3]) + len(parts[4]):]
        lost, gap = {3, 4}, (at, len(parts[3]) + len(parts[4]))
    else:
        junk = b"\x1f\x8b\x08 not gzip WARC/1.1\r\nnot a record" * 5
        data = data[:at] + junk + data[at:]
        lost, gap = set(), (at, len(junk))
    ids, gaps = salvaged(data)
    assert ids == [i for i in range(8) if i not in lost]
    assert [(g.offset, g.length) for g in gaps] == [gap] and gaps[0].reason


def test_salvage_of_uncompressed_records_with_wrong_lengths():
    import gzip
    plain = [gzip.decompress(m) for m in members(4)]
    broken = plain[1].replace(b"Content-Length: ", b"Content-Length: 9", 2)
    ids, gaps = salvaged(plain[0] + broken + plain[2] + members(4)[3])
    assert ids == [0, 2, 3] and [(g.offset, g.length) for g in gaps] == [(len(plain[0]), len(broken))]
    wrong = plain[1].replace(b"<html>1", b"<html>9")          # digest no longer holds
    ids, gaps = salvaged(plain[0] + wrong + plain[2])
    assert ids == [0, 2] and "digest" in gaps[0].reason


def test_salvage_property():
    rnd = random.Random(3)
    parts = members(12)
    whole = b"".join(parts)
    for _ in range(60):
        data = bytearray(whole)
        for _ in range(rnd.randrange(1, 4)):
            at = rnd.randrange(len(data))
            data[at:at + rnd.randrange(1, 30)] = rnd.randbytes(rnd.randrange(0, 30))
        ids, _ = salvaged(bytes(data))
        untouched = [i for i, p in enumerate(parts) if p in bytes(data)]
        assert set(untouched) <= set(ids)


# ---- nearest neighbours --------------------------------------------------------------

def exact(rows, is_query, k):
    """Brute force over (id, vector) rows that take part."""
    size = max({len(v) for _, v in rows}, key=lambda n: (sum(len(v) == n for _, v in rows), -n))
    good = {(i, tuple(v)) for i, v in rows if len(v) == size}
    ids = np.array([i for i, _ in sorted(good)])
    x = np.array([v for _, v in sorted(good)], dtype=np.float64)
    out = {}
    for q, v in zip(ids, x):
        if is_query(q):
            s = (x * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
            out[int(q)] = [(int(ids[j]), s[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(own) + 1
        own.append((r["vec_id"], r["score"]))
    return out


SCHEMA = "vec_id long, embedding array<float>, label int, leaf long, ids string, best int"


def test_odd_vectors(spark):
    good = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(40)]
    odd = [(None, [1.0, 1.0, 1.0]), (100, None), (120, []), (140, [0.0, 0.0, 0.0]),
           (160, [None, 1.0, 1.0]), (180, [float("nan"), 1.0, 1.0]), (200, [float("inf"), 1.0, 1.0]),
           (220, [1.0, 2.0]), good[3], good[20]]
    docs = spark.createDataFrame([(i, v, 0, 1, "x", 2) for i, v in good + odd], SCHEMA).repartition(3)
    got = found(kmeans_tree.nearest(docs, F.col("vec_id") % 20 == 0, k=7))
    want = exact(good, lambda q: q % 20 == 0, 7)
    assert {q: [i for i, _ in r] for q, r in got.items()} == {q: [i for i, _ in r] for q, r in want.items()}
    few = spark.createDataFrame([(20, [1.0, 0.0]), (1, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert found(kmeans_tree.nearest(few, F.col("vec_id") % 20 == 0)) == {20: [(1, 2.0)]}
    none = spark.createDataFrame([], SCHEMA)
    assert kmeans_tree.nearest(none, F.col("vec_id") % 20 == 0).count() == 0


def test_recall_with_a_hot_vector_and_many_cells(spark, monkeypatch):
    random_ = np.random.default_rng(4)
    centres = random_.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.3 * random_.normal(size=16)).astype(np.float32).tolist())
            for i in range(3000)]
    hot = rows[7][1]
    rows = [(i, hot if i % 3 == 0 else v) for i, v in rows]          # a third share one vector
    monkeypatch.setattr(kmeans_tree, "LEAF_ROWS", 60)
    monkeypatch.setattr(kmeans_tree, "CELL", 32)
    got = found(kmeans_tree.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"),
                                    F.col("vec_id") % 20 == 0))
    want = exact(rows, lambda q: q % 20 == 0, 20)
    assert set(got) == set(want) and all(len(r) == 20 for r in got.values())
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want]
    assert sum(hits) >= 0.9 * 20 * len(hits)
    for q, r in got.items():
        assert r == sorted(r, key=lambda x: (-x[1], x[0])) and q not in {i for i, _ in r}


def test_best_bins_visit_every_leaf_once():
    random_ = np.random.default_rng(5)
    rows = random_.normal(size=(900, 8))
    tree = kmeans_tree.fit(rows, float(np.linalg.norm(rows, axis=1).max()), 30)
    order = list(tree.best_bins(rows[0]))
    assert sorted(order) == list(range(tree.leaves)) and tree.leaves >= 15
    assert set(tree.place(rows)) <= set(order)
