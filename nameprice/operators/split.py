"""Deterministic train/validation splits.

Membership is a function of the row id (md5), never of partitioning, so a
retried task or a lost executor reproduces the same split.

* random split: md5 bucket of the id in [0, 100) below the validation percent.
* stratified split: per price stratum (q quantile bins), exactly
  ceil(n_b · pct / 100) rows with the smallest (md5 key, id) go to validation.

The stratified split never ranks a whole stratum in one task (a stratum is
1/q of the table). It finds each stratum's cut row by radix selection on the
60-bit md5 key: a 12-bit then a 16-bit round of (stratum, digit) counts, each
a partial aggregate plus a window over at most 65,536 digits per stratum;
then an exact rank among the ~n/2^28 rows that share the 28-bit prefix. The cut table
has one row per stratum, so broadcasting it is bounded by q + 1 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nameprice.operators.profile import quantile_bins
from nameprice.operators.quantiles import exact_quantiles, qcut_probs, value_counts
from nameprice.session import checkpoint


def md5_bucket(id_col: str | Column, modulo: int = 100) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")
    return h % modulo


def md5_key(id_col: str | Column) -> Column:
    """60-bit non-negative order key from the id's md5 (uniform)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 15), 16, 10).cast("bigint")


def split_random(df: DataFrame, id_col: str = "product_id", val_pct: int = 20,
                 out: str = "split") -> DataFrame:
    s = F.when(md5_bucket(id_col) < val_pct, F.lit("val")).otherwise(F.lit("train"))
    return df.withColumn(out, s)


def _digit_cut(rows: DataFrame, group: str, digit: Column, need: str) -> DataFrame:
    """Per group, the digit value holding the `need`-th row (1-based) and the
    remaining need inside that digit. `rows` carries `need` per group."""
    counts = rows.groupBy(group, digit.alias("d")).agg(
        F.count(F.lit(1)).alias("c"), F.first(need).alias("need"))
    w = Window.partitionBy(group).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("incl", F.sum("c").over(w))
    hit = cum.where((F.col("incl") - F.col("c") < F.col("need")) & (F.col("need") <= F.col("incl")))
    return hit.select(group, F.col("d").alias("cut_d"),
                      (F.col("need") - (F.col("incl") - F.col("c"))).alias("rest"))


def kth_smallest_per_group(df: DataFrame, group: str, key: str, id_col: str,
                           k: DataFrame) -> DataFrame:
    """(group, cut_key, cut_id): the k-th smallest (key, id) per group (1-based).

    `k` has (group, k). Groups with k = 0 are absent from the result.
    `key` must be a non-negative 60-bit integer.
    """
    base = df.select(group, key, id_col).join(F.broadcast(k.where(F.col("k") > 0)), group)
    hi = F.shiftright(F.col(key), 48)
    cut1 = _digit_cut(base.withColumnRenamed("k", "need"), group, hi, "need")
    lvl2 = base.join(F.broadcast(cut1), group).where(hi == F.col("cut_d")).drop("k", "cut_d")
    mid = F.shiftright(F.col(key), 32).bitwiseAND(F.lit(0xFFFF))
    cut2 = _digit_cut(lvl2.withColumnRenamed("rest", "need"), group, mid, "need")
    lvl3 = (lvl2.join(F.broadcast(cut2.withColumnRenamed("rest", "need2")), group)
            .where(mid == F.col("cut_d")))
    w = Window.partitionBy(group).orderBy(key, id_col)
    ranked = lvl3.withColumn("rk", F.row_number().over(w))
    return ranked.where(F.col("rk") == F.col("need2")).select(
        group, F.col(key).alias("cut_key"), F.col(id_col).alias("cut_id"))


def split_stratified(df: DataFrame, id_col: str = "product_id", price_col: str = "price",
                     q: int = 10, val_pct: int = 15, out: str = "split") -> DataFrame:
    """Exact-size stratified split over q price-quantile strata, by radix selection.

    (id, price, key) is checkpointed once; edges and stratum sizes come from one table of
    (price, rows). The ≤ q+1 edges are read once and become literals.
    """
    narrow = checkpoint(df.select(id_col, price_col, md5_key(id_col).alias("_key")))
    counts = value_counts(narrow, price_col)
    row = exact_quantiles(counts, price_col, qcut_probs(q), weight="_w").select(F.array_distinct("q")).first()
    edges = list(row[0] or [])
    k = quantile_bins(counts, price_col, q, "stratum", edges).groupBy("stratum").agg(
        F.ceil(F.sum("_w") * val_pct / F.lit(100)).cast("bigint").alias("k"))
    cuts = kth_smallest_per_group(quantile_bins(narrow, price_col, q, "stratum", edges), "stratum", "_key",
                                  id_col, checkpoint(k))
    binned = quantile_bins(df, price_col, q, "stratum", edges).withColumn("_key", md5_key(id_col))
    joined = binned.join(F.broadcast(checkpoint(cuts)), "stratum", "left")      # one row per stratum
    is_val = F.struct(F.col("_key"), F.col(id_col)) <= F.struct(F.col("cut_key"), F.col("cut_id"))
    s = F.when(F.col("cut_key").isNotNull() & is_val, F.lit("val")).otherwise(F.lit("train"))
    return joined.select(*df.columns, "stratum", s.alias(out))
