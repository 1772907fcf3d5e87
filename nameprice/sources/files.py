"""File sources and sinks: price CSVs, prediction files, analytics tables,
metrics JSON and the append-only experiment log.

Every reader declares its schema (no inference pass over the data) and every
writer is a distributed Spark write into a directory; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_SCHEMA = "name STRING, price LONG"
TEST_SCHEMA = "name STRING"
PREDICTION_SCHEMA = "name STRING, price DOUBLE"
LOG_SCHEMA = ("preprocessing STRING, vectorization STRING, model STRING, use_log BOOLEAN, "
              "val_smape STRING, train_time STRING, full_name STRING")


def read_price_csv(spark: SparkSession, path: str, schema: str = TRAIN_SCHEMA,
                   id_col: str = "product_id") -> DataFrame:
    """Header CSV with quoted, possibly multi-line names; adds a row id.

    The id is `monotonically_increasing_id()`: it depends only on the file
    splits and row order, so a recomputed task yields the same ids.
    """
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
          .option("escape", '"').option("mode", "PERMISSIVE").csv(path))
    return df.select(F.monotonically_increasing_id().alias(id_col), *df.columns)


ID_BLOCK = 65_536          # equal rows numbered by one task at a time


def with_stable_ids(df: DataFrame, id_col: str = "product_id") -> DataFrame:
    """Rows with an id that depends on their values alone, not on files, splits or order.

    The id is the MD5 of the row's values and its number among equal rows (from 0). Equal
    rows can't be told apart, so they are counted (partial aggregates) and laid out again
    from their count, a hot row in blocks of `ID_BLOCK` that are spread over tasks.
    """
    names = df.columns
    n, block, number = "__rows", "__block", "__number"
    counted = df.groupBy(*names).agg(F.count(F.lit(1)).alias(n))
    blocks = counted.withColumn(block, F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col(n) - 1) / ID_BLOCK)))).repartition(*names, block)
    rows = blocks.withColumn(number, F.explode(F.sequence(
        F.col(block) * ID_BLOCK, F.least(F.col(n), (F.col(block) + 1) * ID_BLOCK) - 1)))
    # lengths keep neighbouring values apart; a null has none
    values = [F.coalesce(F.concat(F.length(F.col(c).cast("string")), F.lit(":"), F.col(c).cast("string")),
                         F.lit("null")) for c in names]
    return rows.select(F.md5(F.concat_ws(",", *values, F.col(number).cast("string"))).alias(id_col), *names)


def write_predictions(df: DataFrame, path: str) -> None:
    """Prediction sink: exactly (name, price), header, no index."""
    (df.select("name", F.col("price").cast("double").alias("price"))
       .write.mode("overwrite").option("header", True).csv(path))


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Analytics-table sink (category summary, correlations, feature sample)."""
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this run has written and nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_metrics_json(metrics_long: DataFrame, path: str) -> None:
    """Metrics sink: the long (model, metric, split, value) table as JSON lines."""
    metrics_long.write.mode("overwrite").json(path)


def write_run_json(spark: SparkSession, run: dict, path: str) -> None:
    """Run-metadata sink: one JSON object (best model, counts) with the time of the run."""
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in run.items())
    spark.createDataFrame([tuple(run.values())], schema).withColumn(
        "finished", F.current_timestamp()).coalesce(1).write.mode("overwrite").json(path)


def write_top_importance(importance: DataFrame, path: str, k: int = 150) -> None:
    """Importance sink: the k most important features (a top-k report)."""
    write_table(importance.orderBy(F.desc("importance"), F.asc("feature")).limit(k), path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append-only experiment log (parquet; the schema is fixed on first write)."""
    rows.write.mode("append").parquet(path)


def commit_run(rows: DataFrame, path: str) -> None:
    """Write finished runs, each (`run_key`) as a partition of its own: committing a run again,
    after a restart or by a retry, replaces it and leaves all others alone."""
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("run_key").parquet(path))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
