"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import os
import uuid

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nameprice.session import ensure_checkpoint_dir

ROW_MASK = (1 << 33) - 1        # monotonically_increasing_id: row number inside its partition


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share_package() -> None:
    """Let Python workers import this package from where the driver has it.

    Enough in local mode and where machines share an installation; elsewhere the
    submitter ships the package (`--py-files`).
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = SparkContext.getOrCreate().environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def worker_udf(returns: str):
    """Arrow-batched Pandas UDF whose workers can import this package."""
    share_package()
    return F.pandas_udf(returns)


def release_memory() -> None:
    """Give what a finished task has freed back to the system: a worker lives on beside the next
    stage's tasks, and an executor's memory is that of its JVM and all its workers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # glibc alone has it
    if trim is not None:
        trim(0)


def shared_folder(spark: SparkSession, label: str) -> str:
    """URI of a fresh folder under the shared `spark.checkpoint.dir`."""
    base = ensure_checkpoint_dir(spark)
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def with_positions(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Add `out`: the gapless position (from 0) of each row inside its group.

    One range exchange on (group, order) and one sort; no group ever meets in one
    task. The sorted rows are checkpointed, so the positions inside partitions
    are fixed; the offset table has at most (partitions + groups) rows, which
    bounds its broadcast. Rows equal in `order` get neighbouring positions in
    either order. Nulls sort first and null groups form one group.
    """
    keys = [*group, *order]
    placed = checkpoint(df.repartitionByRange(*keys).sortWithinPartitions(*keys))
    tagged = placed.select("*", F.spark_partition_id().alias("_part"),
                           F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_MASK)).alias("_row"))
    runs = tagged.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"),
                                               F.min("_row").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = runs.select(
        F.col("_part").alias("_o_part"), *[F.col(g).alias(f"_o_{g}") for g in group],
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_off"))
    on = F.col("_part") == F.col("_o_part")
    for g in group:
        on = on & same(F.col(g), F.col(f"_o_{g}"))
    return tagged.join(F.broadcast(offsets), on).select(
        *df.columns, (F.col("_row") + F.col("_off")).alias(out))
