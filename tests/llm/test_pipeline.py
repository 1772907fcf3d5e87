"""Registered queries and the pipeline on the small tables."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SF_SMALL
from nameprice.llm import bpe_tree, pfair
from test_documents import brute_components, norm

LLM = sorted(n for n in entry.queries() if n.startswith("op") and n[2].isdigit())


def test_every_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in LLM) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", [n for n in LLM if n in entry.oracle_sql()])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF_SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    got = sorted(str(tuple(r[c] for c in cols)) for r in df.collect())
    listed = ", ".join(f'"{c}"' for c in cols)
    rows = con.execute(f"select {listed} from ({entry.oracle_sql()[name]})").fetchall()
    assert got == sorted(map(str, rows))


def test_pipeline_against_brute_force(spark, tmp_path):
    cols = None
    docs = spark.read.parquet(os.path.join(SF_SMALL, "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        cols = cols or docs.columns
        path = str(tmp_path / name)
        stage(spark, docs, SF_SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r["doc_id"]: r.asDict() for r in docs.collect()}
        assert len(seen[name]) == docs.count()
        if name != "encode":
            assert docs.columns == cols
    texts = {i: r["text"] for i, r in seen["language"].items()}
    assert len(texts) >= 0.97 * 200
    first = {}
    for i in sorted(texts):
        first.setdefault(norm(texts[i]), i)
    assert set(seen["exact_dedup"]) == set(first.values())
    want = brute_components([(i, texts[i]) for i in seen["exact_dedup"]], 80)
    assert set(seen["near_dedup"]) == {i for i, c in want.items() if i == c}
    assert set(seen["mix"]) == set(seen["near_dedup"])
    kept = spark.read.parquet(str(tmp_path / "near_dedup"))
    order = [r["doc_id"] for r in sorted(pfair.mix(kept).collect(), key=lambda r: (r["slot"], r["idx"]))]
    slots = {i: (r["slot"], r["slot_idx"]) for i, r in seen["encode"].items()}
    assert sorted(slots, key=slots.get) == order
    encoder = bpe_tree.encoder(bpe_tree.RANKS)
    assert set(seen["encode"]) == set(seen["mix"])
    for i, r in seen["encode"].items():
        assert r["intact"] and encoder.decode(r["ids"]).decode() == texts[i]
        assert hashlib.sha256(bytes(str(r["ids"]), "ascii")).digest() == hashlib.sha256(
            bytes(str(encoder.encode(texts[i])), "ascii")).digest()
