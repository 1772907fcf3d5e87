"""Partitioning guards for CPU-bound row work."""

from __future__ import annotations

from pyspark.sql import DataFrame

SPLITS = 4                 # tasks per core that row work is dealt to

def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition unless the input has some splits for every core.

    Row features are CPU-bound regex work and need a few tasks per core. A large
    input already has many splits and is returned untouched (no shuffle). With few splits
    their number says little: a row group is read by one split and its neighbours are
    empty, so a file of one row group would run on one core.
    """
    spark = df.sparkSession
    target = min_partitions or SPLITS * spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target)
