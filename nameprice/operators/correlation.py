"""Per-feature Pearson correlation with the target, in one aggregate pass over long rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlations_with(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, correlation) ordered by |correlation| desc, NULL for constants.

    `corr` raises DIVIDE_BY_ZERO on a constant column under ANSI mode, so the
    ratio is `try_divide(covar_pop, stddev_pop · stddev_pop)`. Every row becomes one
    (feature number, x, y) per feature, and a partial aggregate by number reduces them: an
    aggregate of all features side by side is too long for the JVM to compile. A feature
    without rows has NULL.
    """
    cells = df.select(F.col(target).cast("double").alias("_y"),
                      F.posexplode(F.array(*[F.col(c).cast("double") for c in features])).alias("_i", "_x"))
    found = cells.groupBy("_i").agg(F.try_divide(
        F.covar_pop("_x", "_y"), F.stddev_pop("_x") * F.stddev_pop("_y")).alias("r"))
    row = found.agg(F.map_from_entries(F.collect_list(F.struct("_i", "r"))).alias("_r"))
    stacked = F.posexplode(F.array(*[F.lit(c) for c in features])).alias("_i", "feature")
    longf = row.select("_r", stacked).select("feature", F.try_element_at("_r", F.col("_i")).alias("correlation"))
    return longf.orderBy(F.abs("correlation").desc_nulls_last(), F.asc("feature"))
