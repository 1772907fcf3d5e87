"""The last stage follows the order that the mix wrote."""

from pyspark.sql import functions as F

import corpus_pipeline
from nameprice.llm import pfair


def test_slots_follow_the_files_of_the_mix(spark, tmp_path):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"),
                                   F.lit("en").alias("lang"), F.lit("a").alias("source"), F.lit("x").alias("slot"))
    # an order that no schedule gives: encode has to follow it, over several files
    docs.repartitionByRange(4, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id")).write.option(
        "maxRecordsPerFile", 10).parquet(str(tmp_path / "mix"))
    mixed = spark.read.parquet(str(tmp_path / "mix"))
    rows = {(r["slot"], r["slot_idx"]): r["doc_id"]
            for r in corpus_pipeline.encode_ids(spark, mixed, str(tmp_path)).collect()}
    assert rows == {(k // pfair.BLOCK_ROWS, k % pfair.BLOCK_ROWS): 99 - k for k in range(100)}
    placed = pfair.with_places(mixed)
    assert sorted(placed.columns) == sorted([*docs.columns, "slot_idx"])
    assert "SortMergeJoin" not in placed._jdf.queryExecution().executedPlan().toString()


def test_slots_of_the_mix_itself(spark, tmp_path):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"),
                                   F.when(F.col("id") < 200, "a").when(F.col("id") < 290, "b").alias("source"))
    mixed = pfair.keep_mix(docs.repartition(5))
    mixed.write.parquet(str(tmp_path / "mix"))
    got = pfair.with_places(spark.read.parquet(str(tmp_path / "mix"))).orderBy("slot", "slot_idx").collect()
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in mixed.collect()] and len(got) == 300


def test_workers_keep_no_texts_between_stages():
    """What a stage's tasks remember is bounded and goes at their end, so that memory does not add up over stages."""
    from nameprice.llm import bpe_tree, langid, odd_sketch

    odd_sketch.shingles("some words that a task has met")
    assert odd_sketch.HASHES
    odd_sketch.forget()
    assert not odd_sketch.HASHES
    own = bpe_tree.TreeBPE(most=3)
    texts = [f"part{i} of a text {i}" for i in range(20)]
    assert [own.decode(own.encode(t)) for t in texts] == [t.encode() for t in texts]
    assert len(own.parts) <= 3
    assert langid._worker.cache_info().maxsize == 1
