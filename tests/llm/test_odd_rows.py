"""Rows without ids, equal rows and odd tables in sharding, near-dedup, mixing and the pipeline."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from nameprice.llm import histogram_sort, odd_sketch, pfair

WORDS = [f"w{i}" for i in range(400)]
BASE = " ".join(WORDS[:300])


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_equal_rows_are_dealt_over_shards(spark):
    rows = [(1, "same text", "en", "a", 9)] * 600 + [(i + 10, "x" * 9, "en", "a", 9) for i in range(400)]
    out = histogram_sort.shard_documents(documents(spark, rows))
    sizes = {r["shard"]: r["s"] for r in out.groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 20
    slots = out.select("shard", "slot").collect()
    per = collections.defaultdict(list)
    for r in slots:
        per[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in per.values())


def test_null_ids_are_linked_and_dropped(spark):
    other = " ".join(WORDS[100:])
    rows = [(2, BASE, "en", "a", 0), (None, BASE + " more", "en", "a", 0), (7, other, "en", "a", 0),
            (None, "one two three four five six", "en", "a", 0), (None, None, "en", "a", 0),
            (None, "q " + " ".join(WORDS[50:380]), "en", "b", 0), (None, " ".join(WORDS[50:380]), "en", "b", 0)]
    docs = documents(spark, rows)
    out = odd_sketch.near_duplicates(docs, 85)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out.collect()), key=str)
    assert got == sorted([(2, 296, 2, True), (None, 297, 2, False), (7, 296, 7, True), (None, 2, None, True),
                          (None, 0, None, True), (None, 327, None, got_kept(out, 327)),
                          (None, 326, None, not got_kept(out, 327))], key=str)
    left = odd_sketch.drop_near_copies(docs, 85).collect()
    assert len(left) == 5 and BASE + " more" not in {r["text"] for r in left}
    assert len([r for r in left if r["source"] == "b"]) == 1


def got_kept(out, n):
    return out.where(F.col("n_shingles") == n).first()["kept"]


def test_a_repeated_id_joins_its_texts(spark):
    far = " ".join(f"z{i}" for i in range(50))
    rows = [(3, BASE, "en", "a", 0), (3, far, "en", "a", 0), (5, far + " end", "en", "a", 0)]
    out = {(r["doc_id"], r["component_id"]) for r in odd_sketch.near_duplicates(documents(spark, rows), 85).collect()}
    assert out == {(3, 3), (5, 3)}


def test_slots_carry_the_order_of_the_mix(spark, tmp_path):
    rows = [(i, f"text {i}", "en", "ab"[i % 3 > 0] if i < 300 else "c", 0) for i in range(310)] + [(None, "t", "en", None, 0)]
    docs = documents(spark, rows)
    mixed = pfair.keep_mix(docs)
    wanted = [r["text"] for r in mixed.collect()]
    mixed.repartition(5).write.parquet(str(tmp_path / "mix"))
    again = pfair.with_slots(spark.read.parquet(str(tmp_path / "mix"))).collect()
    assert [r["text"] for r in sorted(again, key=lambda r: (r["slot"], r["slot_idx"]))] == wanted
    assert len({(r["slot"], r["slot_idx"]) for r in again}) == len(rows)


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    text = "the quick brown fox and the lazy dog went over the hill to the river " * 3
    rows = [(i, f"{text} number {i}", "en", "a", 1) for i in range(40)] + [
        (None, text + " apart from all others " * 9, "en", None, 1), (3, text + " third again", None, "b", 1),
        (50, None, "en", "a", 0), (51, "", None, "a", 0), (52, "1234 5678", "en", "a", 9), (53, text, "en", "a", 1),
        (54, text, "en", "a", 1)]
    for name, data in (("odd", rows), ("empty", [])):
        docs = documents(spark, data).withColumn("kept", F.lit(1)).withColumn("slot", F.lit("x"))
        columns = docs.columns
        for stage, fn in corpus_pipeline.STAGES:
            path = str(tmp_path / name / stage)
            fn(spark, docs, str(tmp_path)).write.parquet(path)
            docs = spark.read.parquet(path)
            if stage != "encode":
                assert docs.columns == columns
        out = docs.collect()
        assert (len(out) > 0) == (name == "odd")
        assert all(r["intact"] for r in out) and len({(r["slot"], r["slot_idx"]) for r in out}) == len(out)
