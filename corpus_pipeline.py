"""Corpus pipeline over `documents`: every stage calls one operator of nameprice.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's `docs`. All stages but the last return
the columns of `docs`; rows with null or empty texts have no letters, so the first
stage drops them. Rows that repeat a text go in exact_dedup, whatever their ids (ties: the
smallest doc_id stays, null ids last); texts of any length are worked on whole; an empty table
gives an empty result with the same columns. Extra columns stay up to the last stage, which
returns doc_id, lang, source, slot, slot_idx, n_tokens, ids and intact alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nameprice.llm import bpe_tree, chunk_dedup, langid, odd_sketch, pfair
from nameprice.llm.common import shared_folder, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compression classifier does not reject."""
    return langid.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id."""
    return chunk_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id."""
    return odd_sketch.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the Pfair mix; a source that runs out leaves it."""
    return pfair.keep_mix(docs)


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, checked by decoding them, with its slot in the mix,
    which follows from the row's place in the files that the mix stage wrote."""
    return bpe_tree.encoded(pfair.with_places(docs), keep=("slot", "slot_idx"))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("encode", encode_ids),
]

# compression, MinHash components and BPE have no SQL form: see tests/llm
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`; returns the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
