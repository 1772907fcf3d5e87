"""Profiling of a price table: describe, nulls, duplicates, histograms, box plot,
quantile bins and the per-category price summary.

Global statistics that feed row expressions (min/max, quantile edges, fences)
are scalar subqueries (`DataFrame.scalar()`): one small aggregate whose value
reaches every task as a literal, with no join and no driver round trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameprice.operators.quantiles import exact_quantile_edges, exact_quantiles, value_counts


def describe(df: DataFrame, col: str = "price") -> DataFrame:
    """count, mean, sample std, min, exact interpolated quartiles, max (one row)."""
    x = F.col(col)
    stats = df.agg(
        F.count(x).alias("count"),
        (F.sum(x).cast("double") / F.count(x)).alias("mean"),
        F.stddev_samp(x.cast("double")).alias("std"),
        F.min(x).cast("double").alias("min"),
        F.max(x).cast("double").alias("max"),
    )
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75])
    return stats.select(
        "count", "mean", "std", "min",
        q.select(F.col("q")[0]).scalar().alias("q25"),
        q.select(F.col("q")[1]).scalar().alias("median"),
        q.select(F.col("q")[2]).scalar().alias("q75"),
        "max")


def null_counts(df: DataFrame) -> DataFrame:
    """(column, null_count) per column plus a `__total__` row; one scan."""
    cols = df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stacked = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("bigint").alias("null_count"))
        for c in cols] + [
        F.struct(F.lit("__total__").alias("column"),
                 sum([F.col(c) for c in cols[1:]], F.col(cols[0])).cast("bigint")
                 .alias("null_count"))]))
    return wide.select(stacked.alias("s")).select("s.column", "s.null_count")


def duplicate_counts(df: DataFrame, row_cols: list[str], key_col: str = "name") -> DataFrame:
    """Occurrences beyond the first, for whole rows and for one key; nulls equal.

    `groupBy` treats nulls as one group (unlike countDistinct, which drops
    them); partial aggregation keeps hot keys map-side.
    """
    rows = df.groupBy(*row_cols).count().agg(F.sum(F.col("count") - 1).alias("d"))
    keys = df.groupBy(key_col).count().agg(F.sum(F.col("count") - 1).alias("d"))
    return rows.select(
        F.coalesce(F.col("d"), F.lit(0)).cast("bigint").alias("duplicate_rows"),
        F.coalesce(keys.select("d").scalar(), F.lit(0)).cast("bigint").alias("duplicate_names"))


def histogram(df: DataFrame, value: Column, bins: int = 100) -> DataFrame:
    """Equal-width histogram: bin = least(floor((x-min)/(max-min)*bins), bins-1).

    Only non-empty bins are returned (bin, bin_lo, bin_hi, n). NULL and NaN are in no bin.
    """
    vals = df.select(value.cast("double").alias("x")).where(
        F.col("x").isNotNull() & ~F.isnan("x"))
    lo = vals.select(F.min("x")).scalar()
    hi = vals.select(F.max("x")).scalar()
    width = hi - lo
    b = F.when(width > 0, F.least(F.floor((F.col("x") - lo) / width * bins),
                                  F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counted = vals.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "bin",
        (lo + width * F.col("bin") / F.lit(float(bins))).alias("bin_lo"),
        (lo + width * (F.col("bin") + 1) / F.lit(float(bins))).alias("bin_hi"),
        "n")


def boxplot_stats(df: DataFrame, col: str = "price") -> DataFrame:
    """Quartiles, 1.5·IQR whiskers (most extreme data inside the fences), outliers."""
    x = F.col(col).cast("double")
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75])
    q1 = q.select(F.col("q")[0]).scalar()
    q3 = q.select(F.col("q")[2]).scalar()
    med = q.select(F.col("q")[1]).scalar()
    proj = df.select(x.alias("x"), q1.alias("q1"), q3.alias("q3"), med.alias("median"))
    iqr = F.col("q3") - F.col("q1")
    lo_f = F.col("q1") - 1.5 * iqr
    hi_f = F.col("q3") + 1.5 * iqr
    inside = (F.col("x") >= lo_f) & (F.col("x") <= hi_f)
    return proj.agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"), (F.first("q3") - F.first("q1")).alias("iqr"),
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.count_if(F.col("x").isNotNull() & ~inside).cast("bigint").alias("outliers"),
    )


def quantile_bins(df: DataFrame, col: str = "price", q: int = 10,
                  out: str = "price_bin", edges: list[float] | None = None) -> DataFrame:
    """pd.qcut(q, duplicates='drop') semantics: interpolated edges, right-closed,
    lowest edge included; bin = greatest(#edges below x − 1, 0).

    The edge array (≤ q+1 values) is a scalar subquery, or a literal when the
    caller already read it, so binning is narrow.
    """
    e = exact_quantile_edges(df, col, q) if edges is None else \
        F.array(*[F.lit(float(v)) for v in edges])
    staged = df.select("*", e.alias("_edges"))
    x = F.col(col).cast("double")
    b = F.greatest(F.size(F.filter("_edges", lambda e: e < x)) - 1, F.lit(0))
    return staged.select(*df.columns, b.cast("int").alias(out))


def category_price_summary(df_with_category: DataFrame, cat_col: str = "primary_category",
                           col: str = "price") -> DataFrame:
    """Per category: count, mean, median, sample std, min, max; by mean desc.

    Everything comes from one table of (category, price, rows), so the category columns are
    evaluated once; deviations are summed around the category's mean (categories come from
    a fixed list, their means are a small table).
    """
    counts = value_counts(df_with_category, col, [cat_col])
    x, w = F.col(col).cast("double"), F.when(F.col(col).isNotNull(), F.col("_w"))
    n = F.coalesce(F.sum(w), F.lit(0))
    stats = counts.groupBy(cat_col).agg(
        n.alias("count"), (F.sum(F.col(col) * w).cast("double") / F.when(n > 0, n)).alias("mean"),
        F.min(x).alias("min"), F.max(x).alias("max"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    means = stats.select(F.col(cat_col).alias("_m"), "mean", F.col("count").alias("_n"))
    spread = counts.join(F.broadcast(means), same(cat_col, "_m")).groupBy(F.col(cat_col).alias("_s")).agg(
        F.sum(w * (x - F.col("mean")) * (x - F.col("mean"))).alias("_d"), F.first("_n").alias("_n"))
    spread = spread.select("_s", F.when(F.col("_n") > 1, F.sqrt(F.col("_d") / (F.col("_n") - 1))).alias("std"))
    medians = exact_quantiles(counts, col, [0.5], [cat_col], "_w").select(
        F.col(cat_col).alias("_cat"), F.col("q")[0].alias("median"))
    joined = stats.join(spread, same(cat_col, "_s"), "left").join(medians, same(cat_col, "_cat"), "left")
    return joined.select(cat_col, "count", "mean", "median", "std", "min", "max").orderBy(
        F.desc("mean"), F.asc(cat_col))
