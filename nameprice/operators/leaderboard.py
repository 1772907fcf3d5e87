"""Experiment-log leaderboard: text metrics cast on read, stats, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLDS = (40, 30, 25)


def typed_log(log: DataFrame) -> DataFrame:
    """Cast the text metrics to DOUBLE (unparsable → NULL, never an error)."""
    return log.withColumn("val_smape", F.col("val_smape").try_cast("double")) \
              .withColumn("train_time", F.col("train_time").try_cast("double"))


def latest_only(log: DataFrame) -> DataFrame:
    """Keep the last appended run per full_name (max run_id): partial max_by."""
    keep = log.groupBy("full_name").agg(F.max("run_id").alias("run_id"))
    return log.join(keep, ["full_name", "run_id"], "left_semi")


def stats(log: DataFrame) -> DataFrame:
    """Running count, best/worst/mean SMAPE and threshold counts (one row)."""
    s = F.col("val_smape")
    return log.agg(
        F.count(F.lit(1)).alias("runs"),
        F.min(s).alias("best_smape"),
        F.max(s).alias("worst_smape"),
        F.avg(s).alias("mean_smape"),
        *[F.count_if(s < t).cast("bigint").alias(f"under_{t}") for t in THRESHOLDS],
    )


def top_k(log: DataFrame, k: int = 5) -> DataFrame:
    """k smallest val_smape; ties keep append order (like a stable nsmallest)."""
    ranked = log.orderBy(F.col("val_smape").asc_nulls_last(), F.col("run_id").asc()).limit(k)
    return ranked.select("run_id", "full_name", "val_smape", "train_time")
