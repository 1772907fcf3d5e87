"""Row features on a stream: every feature family is stateless, so the batch
column builders apply unchanged to `readStream` frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nameprice.functions import features as FT

PRODUCT_SCHEMA = "product_id LONG, name STRING, price LONG"


def product_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return (spark.readStream.schema(PRODUCT_SCHEMA)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def run_features(spark: SparkSession, src: str, out: str, family=FT.with_basic31) -> DataFrame:
    """Append-mode feature stream into a parquet sink; returns the sink's contents."""
    feats = family(product_stream(spark, src))
    handle = (feats.writeStream.format("parquet").outputMode("append")
              .option("path", out).option("checkpointLocation", out + "_ckpt")
              .trigger(availableNow=True).start())
    handle.awaitTermination()
    return spark.read.schema(feats.schema).parquet(out)
