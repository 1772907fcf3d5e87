"""Exact interpolated quantiles (numpy/pandas 'linear' definition), distributed.

Equal values are counted per group first (partial aggregation), then the counts
are range-partitioned by (group, value) and accumulated: inside partitions by a
running sum, across partitions by offsets from a table of one row per partition
and group. A quantile is read off the two values around its position. No group
meets in one task, whatever its number of rows or distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nameprice.session import checkpoint


def value_counts(df: DataFrame, col: str, group_cols: list[str] | None = None,
                 out: str = "_w") -> DataFrame:
    """(group, value, out): rows of every distinct value, NULL included; checkpointed, so that
    what is computed from it evaluates the rows of `df` once."""
    return checkpoint(df.select(*(group_cols or []), col).groupBy(*(group_cols or []), col).agg(
        F.count(F.lit(1)).alias(out)))


def _value_ranks(df: DataFrame, col: str, group_cols: list[str], weight: str | None) -> DataFrame:
    """(group, _v, _lo, _n, _total): each distinct value with the position of its first row."""
    x = F.col(col).cast("double")
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.where(x.isNotNull()).groupBy(*group_cols, (x + F.lit(0.0)).alias("_v")).agg(rows.alias("_c"))
    # checkpointed: both uses below must see the same partitions
    placed = checkpoint(counts.repartitionByRange(*group_cols, "_v").sortWithinPartitions(
        *group_cols, "_v")).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part", *group_cols).orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = placed.withColumn("_incl", F.sum("_c").over(inside))
    runs = placed.groupBy("_part", *group_cols).agg(F.sum("_c").alias("_rows"))
    earlier = Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group_cols)
    offsets = runs.select("_part", *group_cols,
                          F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_off"),
                          F.sum("_rows").over(whole).alias("_total"))
    on = ["_part", *group_cols]
    renamed = offsets.toDF(*[f"_o{c}" for c in on], "_off", "_total")
    match = F.lit(True)
    for c in on:
        match = match & F.col(c).eqNullSafe(F.col(f"_o{c}"))
    joined = local.join(renamed, match)
    return joined.select(*group_cols, "_v", "_c", "_total",
                         (F.col("_off") + F.col("_incl") - F.col("_c")).alias("_lo"))


def exact_quantiles(df: DataFrame, col: str, probs: list[float],
                    group_cols: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """One row per group with `q` = array of exact quantiles (same order as probs). A row
    stands for `weight` rows where that column is named.

    NULL values are ignored; a frame without any value gives one row with NULL
    quantiles (no group column) or no row for the group.
    """
    group_cols = group_cols or []
    ranks = _value_ranks(df, col, group_cols, weight)
    aggs = []
    for i, p in enumerate(probs):
        at = (F.col("_total") - 1) * F.lit(float(p))
        low = F.floor(at)
        holds = lambda k: (F.col("_lo") <= k) & (k < F.col("_lo") + F.col("_c"))
        aggs += [F.max(F.when(holds(low), F.col("_v"))).alias(f"_a{i}"),
                 F.max(F.when(holds(F.least(low + 1, F.col("_total") - 1)), F.col("_v"))).alias(f"_b{i}"),
                 F.max(at - low).alias(f"_f{i}")]
    found = ranks.groupBy(*group_cols).agg(*aggs) if group_cols else ranks.agg(*aggs)
    q = F.array(*[F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}")
                  for i in range(len(probs))])
    return found.select(*group_cols, q.alias("q"))


def qcut_probs(q: int) -> list[float]:
    return [i / q for i in range(q + 1)]


def exact_quantile_edges(df: DataFrame, col: str, q: int) -> Column:
    """Scalar-subquery Column: distinct ascending quantile edges for q bins."""
    edges = exact_quantiles(df, col, qcut_probs(q)).select(F.array_distinct("q"))
    return edges.scalar()
