"""Exact dedup by content-defined chunk recipes (DataFrame functions only).

A normalised text is cut where its own content says so (a boundary depends only
on the characters around it, between a minimum and a maximum size), so equal
texts have equal chunk lists and an insertion moves only the cuts near it. The
chunk dictionary is deduplicated and verified byte by byte: that is the one time
chunk text is moved, and a chunk that repeats inside a task is moved once. From
then on a document is its *recipe*, the ordered list of 8-byte chunk
identifiers, and texts are compared by comparing recipes.

Verification decides on a measured count: if no identifier stands for two
different chunks (the usual case), the hash itself is the identifier; if some
do, each chunk under such a hash gets (hash, rank) and the recipes are rebuilt
from those, so the result is exact for any hash.

Defined cases: null text counts as empty and equals "" (empty recipe). A null
doc_id sorts after all others, so it stays only in a group of null ids. Rows
repeating a doc_id with equal text are separate members of the group; exactly
one of them stays. An empty table gives an empty result. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_CHUNK, MAX_CHUNK = 1024, 8192          # characters
SPACES = r"[\x20\x09-\x0D]+"
# cut after a vowel and a space, before a letter of the last part of the alphabet
BOUNDARY = r"(?<=[aeiou]\x20)(?=[s-z])"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def chunks(text: Column, low: int = MIN_CHUNK, high: int = MAX_CHUNK) -> Column:
    """Content-defined chunks of a text; their concatenation is the text."""
    pattern = f"(?s).{{{low},{high}}}?{BOUNDARY}|.{{1,{high}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def chunk_dictionary(texts: DataFrame, chunk_hash: Callable[[Column], Column]) -> DataFrame:
    """(id, chunk, n): every different chunk with its hash and number of uses."""
    parts = texts.select(F.explode(chunks(F.col("norm"))).alias("chunk"))
    return parts.groupBy(chunk_hash(F.col("chunk")).alias("id"), "chunk").agg(
        F.count(F.lit(1)).alias("n"))


def _ranked_recipes(texts: DataFrame, dictionary: DataFrame, clashing: DataFrame,
                    chunk_hash: Callable[[Column], Column]) -> DataFrame:
    """Recipes whose identifiers tell apart chunks that share a hash."""
    inside = Window.partitionBy("id").orderBy("chunk")
    ranks = dictionary.join(clashing, "id", "left_semi").select(
        F.col("chunk").alias("r_chunk"), F.row_number().over(inside).cast("long").alias("rank"))
    rows = texts.select("doc_id", "text_sha256", "norm",
                        F.monotonically_increasing_id().alias("_row"))
    used = rows.select("doc_id", "text_sha256", "_row",
                       F.posexplode_outer(chunks(F.col("norm"))).alias("pos", "chunk"))
    known = used.join(ranks, used.chunk == ranks.r_chunk, "left").select(
        "doc_id", "text_sha256", "_row", F.when(F.col("pos").isNotNull(), F.struct(
            "pos", chunk_hash(F.col("chunk")).cast("long").alias("id"),
            F.coalesce("rank", F.lit(0)).alias("rank"))).alias("part"))
    lists = known.groupBy("_row", "doc_id", "text_sha256").agg(
        F.sort_array(F.collect_list("part")).alias("parts"))
    recipe = F.flatten(F.transform("parts", lambda p: F.array(p["id"], p["rank"])))
    return lists.select("doc_id", "text_sha256", recipe.alias("recipe"))


def recipes(docs: DataFrame, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, text_sha256, recipe): one row per row of `docs`."""
    texts = docs.select("doc_id", normalised(F.col("text")).alias("norm")).select(
        "doc_id", "norm", F.sha2("norm", 256).alias("text_sha256"))
    dictionary = chunk_dictionary(texts, chunk_hash)
    clashing = dictionary.groupBy("id").count().where("count > 1").select("id")
    if clashing.isEmpty():
        ids = F.transform(chunks(F.col("norm")), lambda c: chunk_hash(c))
        return texts.select("doc_id", "text_sha256", ids.alias("recipe"))
    return _ranked_recipes(texts, dictionary, clashing, chunk_hash)


def exact_dedup(docs: DataFrame, chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_chunks): a row per row of `docs`.

    Group sizes are pre-aggregated per task, and the rows of a group are never
    collected: they meet their group's single row in an equi-join on the recipe,
    whose hot keys AQE splits.
    """
    rows = recipes(docs, chunk_hash).groupBy("recipe", "doc_id", "text_sha256").agg(
        F.count(F.lit(1)).alias("copies"))
    groups = rows.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"),
                                        F.sum("copies").alias("group_size"))
    members = rows.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", "text_sha256", F.size("recipe").alias("n_chunks"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return members.select("doc_id", "keep_id", "group_size", kept.alias("kept"),
                          "text_sha256", "n_chunks")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (all their columns) that stay, one per group of equal texts.

    Whole rows are exchanged once: the join key has no nulls, so dropping rows that
    repeat a doc_id and its text needs no other partitioning.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    stay = exact_dedup(docs).where("kept").select(
        key.alias("__doc_key"), F.col("text_sha256").alias("__norm_sha"))
    keyed = docs.withColumns({"__doc_key": key, "__norm_sha": F.sha2(normalised(F.col("text")), 256)})
    found = keyed.join(stay, ["__doc_key", "__norm_sha"], "left_semi")
    return found.dropDuplicates(["__doc_key", "__norm_sha"]).select(
        *[F.col(f"`{c}`") for c in docs.columns])
