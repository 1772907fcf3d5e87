"""Connected components of a link table, without collecting links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nameprice.llm.common import checkpoint


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """One star step: hang the larger (or smaller) neighbours on the smallest one."""
    if larger:
        pairs = links.union(links.select("b", "a")).toDF("u", "v")
    else:
        pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = pairs.groupBy("u").agg(F.min("v").alias("m"))
    joined = pairs.join(low.withColumnRenamed("u", "k"), F.col("u") == F.col("k")) \
        .withColumn("m", F.least("m", "u"))
    if larger:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
            low.select(F.col("u"), F.col("m")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): smallest node id reachable, for every node with a link.

    `links` has two long columns a and b. Large-star and small-star steps alternate
    until every node hangs on one root only and no root hangs on another node: then
    the root is the smallest of its component. Minima are pre-aggregated; hot hubs
    are joins that AQE splits.
    """
    now = checkpoint(links.select(F.col(links.columns[0]).alias("a"), F.col(links.columns[1]).alias("b"))
                     .where("a <> b"))
    while True:
        now = checkpoint(_stars(_stars(now, True), False))
        ends = now.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("root")).union(
            now.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("hangs").alias("h"), F.max("root").alias("r")).where(
                "h > 1 or h + r > 1").isEmpty():
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(now.select("b", "b").distinct())
