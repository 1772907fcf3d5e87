"""Live leaderboard over an append-only experiment log (Structured Streaming).

* running statistics: a streaming global aggregate in complete mode, whose
  state is one row (count, min, max, sum, threshold counts);
* statistics of the latest run per full_name: a streaming aggregate by full_name,
  whose complete state each batch reduces to one row;
* top-k: each micro-batch's k best rows (a distributed TakeOrderedAndProject,
  at most k rows per partition reach the merge) are merged with the previous
  k best in `foreachBatch` and written as the new top-k table; the state is
  bounded by k, never by the log.

`Trigger.AvailableNow` drains the folder and stops (tests, catch-up jobs);
the same query with a processing-time trigger polls like a monitor.
Checkpoints live under the shared `spark.checkpoint.dir`, so a restarted
query resumes from its committed offsets.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nameprice.operators import leaderboard
from nameprice.session import ensure_checkpoint_dir

LOG_STREAM_SCHEMA = ("run_id LONG, preprocessing STRING, vectorization STRING, model STRING, "
                     "use_log BOOLEAN, val_smape STRING, train_time STRING, full_name STRING")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared checkpoint directory (never machine-local)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{label}-{uuid.uuid4().hex[:12]}")


def log_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(LOG_STREAM_SCHEMA).option("header", True)
            .option("maxFilesPerTrigger", files_per_trigger).csv(path))


def run_stats(spark: SparkSession, src: str, out: str, available_now: bool = True) -> DataFrame:
    """Running leaderboard statistics; returns the final complete-mode result."""
    stats = leaderboard.stats(leaderboard.typed_log(log_stream(spark, src)))

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = (stats.writeStream.outputMode("complete").foreachBatch(sink)
         .option("checkpointLocation", out + "_ckpt"))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    handle = q.start()
    handle.awaitTermination()
    return spark.read.parquet(out)


def run_latest_stats(spark: SparkSession, src: str, out: str) -> DataFrame:
    """Running statistics over the last appended run of each full_name.

    The state store holds one (run_id, val_smape) per full_name, the largest run_id
    so far; every batch's complete state is reduced to the statistics (one row). A
    restarted query takes its state from its checkpoint. Runs without a full_name
    take no part, as in `leaderboard.latest_only`.
    """
    typed = leaderboard.typed_log(log_stream(spark, src)).where("full_name is not null")
    latest = typed.groupBy("full_name").agg(F.max(F.struct("run_id", "val_smape")).alias("last"))

    def sink(batch: DataFrame, epoch: int) -> None:
        leaderboard.stats(batch.select("last.val_smape")).write.mode("overwrite").parquet(out)

    handle = (latest.writeStream.outputMode("complete").foreachBatch(sink)
              .option("checkpointLocation", out + "_ckpt").trigger(availableNow=True).start())
    handle.awaitTermination()
    return spark.read.parquet(out)


TOP_SCHEMA = "run_id long, full_name string, val_smape double, train_time double"


def run_top_k(spark: SparkSession, src: str, out: str, k: int = 5) -> DataFrame:
    """Running k best runs (val_smape asc, append order), merged per micro-batch.

    The state belongs to the epoch: batch e reads version e - 1 and overwrites
    version e, so a retried epoch is not merged twice and a restarted query goes
    on where its committed offsets are.
    """
    typed = leaderboard.typed_log(log_stream(spark, src))

    def merge(batch: DataFrame, epoch: int) -> None:
        best = leaderboard.top_k(batch, k)
        if epoch > 0:
            before = spark.read.schema(TOP_SCHEMA).parquet(f"{out}/version={epoch - 1}")
            best = leaderboard.top_k(before.unionByName(best), k)
        best.write.mode("overwrite").parquet(f"{out}/version={epoch}")

    handle = (typed.writeStream.foreachBatch(merge).trigger(availableNow=True)
              .option("checkpointLocation", out + "_ckpt").start())
    handle.awaitTermination()
    return newest_top_k(spark, out)


def newest_top_k(spark: SparkSession, out: str) -> DataFrame:
    """The top-k table of the last epoch (empty before the first one)."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = [int(f.getPath().getName().partition("=")[2]) for f in files.listStatus(folder)
                if f.getPath().getName().startswith("version=")] if files.exists(folder) else []
    if not versions:
        return spark.createDataFrame([], TOP_SCHEMA)
    return spark.read.schema(TOP_SCHEMA).parquet(f"{out}/version={max(versions)}")


def write_log_files(log: DataFrame, path: str, files: int = 4) -> None:
    """Land the log as several CSV files (the folder the stream reads)."""
    log.repartition(files).write.mode("overwrite").option("header", True).csv(path)

