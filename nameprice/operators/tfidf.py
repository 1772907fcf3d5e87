"""TF-IDF as DataFrame aggregations (fit on one frame, apply to others).

Formulas pinned to the surveyed vectoriser defaults:
  smoothed idf = ln((1 + n) / (1 + df)) + 1,   sublinear tf = 1 + ln(tf),
  rows L2-normalised; min_df/max_df (int = count, float = share of n) prune
  first, then the top `max_features` terms by corpus count (ties by term).

Plan shape (one shuffle per step, none per row):
  * docs are hash-partitioned by doc id once, `TASK_CHARS` characters a task (a text grows
    many times over as n-grams); explode + groupBy(doc, term) and the per-doc norm
    window then reuse that partitioning (no exchange) and fit into a task's memory;
  * document frequency is a partial-aggregating groupBy(term), so a term in
    every document is combined map-side before its single reducer;
  * the vocabulary is a top-k (TakeOrderedAndProject) bounded by
    `max_features`, so broadcasting it into the weight join is size-proven.
    Without a cap the join is left to the planner's size check.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


TASK_CHARS = 1 << 20       # some 3 million character n-grams


@dataclass(frozen=True)
class TfidfConfig:
    max_features: int | None = None
    min_df: int | float = 1
    max_df: int | float = 1.0
    sublinear_tf: bool = False


def term_counts(docs: DataFrame, source: Column, analyzer, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, term, tf): `source` (tokens or prepared text) is projected
    first, then `analyzer(col)` builds the term array from that column, so the
    tokeniser runs once per document rather than once per n-gram position."""
    parted = docs.repartition(_tasks(docs, id_col), id_col).select(id_col, source.alias("_src"))
    exploded = parted.select(id_col, F.explode(analyzer(F.col("_src"))).alias("term"))
    return exploded.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def _tasks(docs: DataFrame, id_col: str) -> int:
    """Tasks for the n-grams of the texts of `docs`; a number of their own, as they would be
    joined by the size of the texts else."""
    texts = [f.name for f in docs.schema.fields if f.name != id_col and isinstance(f.dataType, StringType)]
    chars = docs.select(F.sum(sum((F.coalesce(F.length(c), F.lit(0)).cast("long") for c in texts), F.lit(0)))).first()[0]
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-(chars or 0) // TASK_CHARS))


def word_analyzer(n_min: int, n_max: int):
    from nameprice.functions.text import word_ngrams
    return lambda c: word_ngrams(c, n_min, n_max)


def char_analyzer(n_min: int, n_max: int):
    from nameprice.functions.text import char_ngrams
    return lambda c: char_ngrams(c, n_min, n_max)


def fit_vocabulary(tf: DataFrame, n_docs: Column, cfg: TfidfConfig,
                   id_col: str = "doc_id") -> DataFrame:
    """(term, idx, df, total, idf): the fitted vocabulary, idx in term order."""
    stats = tf.groupBy("term").agg(F.count(id_col).alias("df"), F.sum("tf").alias("total"))
    n = n_docs.cast("double")
    lo = F.lit(cfg.min_df) if isinstance(cfg.min_df, int) else F.lit(cfg.min_df) * n
    hi = F.lit(cfg.max_df) if isinstance(cfg.max_df, int) else F.lit(float(cfg.max_df)) * n
    kept = stats.where((F.col("df") >= lo) & (F.col("df") <= hi))
    if cfg.max_features is not None:
        kept = kept.orderBy(F.desc("total"), F.asc("term")).limit(cfg.max_features)
    idf = F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df").cast("double"))) + F.lit(1.0)
    scored = kept.select("term", "df", "total", idf.alias("idf"))
    if cfg.max_features is not None:
        # at most max_features rows: a global index window is bounded
        w = Window.orderBy("term")
        return scored.select("term", (F.row_number().over(w) - 1).alias("idx"),
                             "df", "total", "idf")
    # uncapped vocabulary: range-partitioned sort, then per-partition offsets
    spark = tf.sparkSession
    indexed = scored.orderBy("term").rdd.zipWithIndex().map(
        lambda p: (p[0]["term"], int(p[1]), int(p[0]["df"]), int(p[0]["total"]), float(p[0]["idf"])))
    return spark.createDataFrame(indexed, "term string, idx long, df long, total long, idf double")


def transform(tf: DataFrame, vocab: DataFrame, cfg: TfidfConfig,
              id_col: str = "doc_id") -> DataFrame:
    """(doc_id, term, idx, weight): out-of-vocabulary terms dropped, rows L2-normed."""
    v = F.broadcast(vocab) if cfg.max_features is not None else vocab
    joined = tf.join(v.select("term", "idx", "idf"), "term")
    t = F.col("tf").cast("double")
    tfw = (F.lit(1.0) + F.log(t)) if cfg.sublinear_tf else t
    weighted = joined.select(id_col, "term", "idx", (tfw * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return weighted.select(id_col, "term", "idx", (F.col("w") / norm).alias("weight"))


def fit_transform(tf: DataFrame, n_docs: Column, cfg: TfidfConfig,
                  id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Fit the vocabulary and weight the same documents.

    Both passes read the term counts; they are persisted once (memory, spilling
    to disk; recomputed from lineage if an executor is lost) instead of
    re-running tokenising and the per-document shuffle. Unpersist `tf` when done.
    """
    from pyspark import StorageLevel

    tf = tf.persist(StorageLevel.MEMORY_AND_DISK)
    vocab = fit_vocabulary(tf, n_docs, cfg, id_col)
    return vocab, transform(tf, vocab, cfg, id_col)
