"""Driver tables and the fixture views derived from them.

The fixtures turn the TPC-H-ish tables into price tables:
`products` (≈ training table), `products_large` (bench-sized),
`predictions` (three pseudo-models per product, long form) and
`experiment_log` (append-only results log, one run per part).
Everything is a lazy DataFrame over the parquet scans, so Catalyst prunes
columns and pushes filters into the readers.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events", "documents", "embeddings", "pages",
                 "benchmark", "labels", "conversations")

# FIXED VALUES: pseudo-model names and multipliers of the `predictions` view; the
# model `failed` has no prediction at all
PSEUDO_MODELS = (("ridge", 37), ("tree_a", 13), ("tree_b", 7), ("failed", 0))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _spread(df: DataFrame) -> DataFrame:
    from nameprice.operators.partitioning import spread
    return spread(df)


def _prefix(k8: Column) -> Column:
    # FIXED VALUES: name decorations of the products view, by p_partkey % 8
    return (F.when(k8 == 0, "【日本進口】").when(k8 == 1, "#A-12 ")
            .when(k8 == 2, "SALE 特價 ").when(k8 == 3, "").when(k8 == 4, "限量 ")
            .when(k8 == 5, "冬 ").when(k8 == 6, "USB 充電 ").otherwise("3/4 "))


def _suffix(k6: Column, size: Column) -> Column:
    # FIXED VALUES: unit/keyword tails of the products view, by p_partkey % 6
    s = size.cast("string")
    return (F.when(k6 == 0, F.concat(s, F.lit("cm 收納櫃")))
            .when(k6 == 1, F.concat((size * 10).cast("string"), F.lit("ML 保濕面膜 5入")))
            .when(k6 == 2, F.concat(s, F.lit(".5kg 米")))
            .when(k6 == 3, F.concat(F.lit("x"), s, F.lit(" 公分 女外套 紅")))
            .when(k6 == 4, F.lit("50% 嬰兒奶瓶 250毫升"))
            .otherwise(F.lit("黃金手錶 !?")))


# FIXED VALUES: price per unit of size for each tail of the products view, by p_partkey % 6
TAIL_PRICES = (11, 3, 40, 25, 8, 300)


def _price(k: Column, size: Column) -> Column:
    """What the name says (tail, size, prefix), ±10 % noise, every 41st a hundredfold."""
    per = F.element_at(F.array(*[F.lit(v) for v in TAIL_PRICES]), (k % 6 + 1).cast("int"))
    noise = F.lit(90) + (k * 7919) % 21
    tail = F.when(k % 41 == 0, F.lit(100)).otherwise(F.lit(1))
    return F.floor((size * per + 50) * (k % 8 + 10) * noise / 1000) * tail


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names and prices need of `part`: its few row groups dealt to every core."""
    return _spread(read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, name, price): one product per part, nulls, zeros, heavy tail."""
    part = _part(spark, sf_dir)
    k = F.col("p_partkey")
    name = F.when(k % 97 == 0, F.lit(None).cast("string")).otherwise(F.concat(
        _prefix(k % 8), F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" "),
        F.col("p_type"), F.lit(" "), _suffix(k % 6, F.col("p_size"))))
    price = F.when(k % 50 == 0, F.lit(0)).otherwise(_price(k, F.col("p_size")))
    return part.select(k.alias("product_id"), name.alias("name"),
                       price.cast("bigint").alias("price"))


def products_unpriced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(product_id, name): products still without a price, one per part, decorated otherwise."""
    part = _part(spark, sf_dir)
    k = F.col("p_partkey")
    name = F.concat(_prefix((k + 3) % 8), F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" "),
                    F.col("p_type"), F.lit(" "), _suffix((k + 1) % 6, F.col("p_size")))
    return part.select((-k - 1).alias("product_id"), name.alias("name"))


def products_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product row per lineitem (bench input, ~ the surveyed train size).

    The join is left to Catalyst/AQE: `products` grows with `part`, so it is
    broadcast only when its measured size is under the broadcast threshold,
    otherwise it is a sort-merge join whose skewed keys AQE splits.
    """
    li = _spread(read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice"))
    p = products(spark, sf_dir)
    pid = (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000
            + F.col("l_partkey")) * 100000 + F.col("l_suppkey"))
    name = F.concat(F.col("name"), F.lit(" "),
                    F.col("l_quantity").cast("int").cast("string"), F.lit("入"))
    return li.join(p, li.l_partkey == p.product_id).select(
        pid.alias("product_id"), name.alias("name"),
        F.floor("l_extendedprice").cast("bigint").alias("price"))


def predictions(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """Long prediction table (product_id, model, y, yhat): four models per product.

    Some predictions are NULL or NaN; all of the model `failed` are NULL. The model list is a generator over each row (narrow, no join).
    """
    base = base if base is not None else products(spark, sf_dir)
    models = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(k).alias("k")) for m, k in PSEUDO_MODELS]))
    exploded = base.select("product_id", "price", models.alias("m"))
    pid = F.col("product_id")
    wobble = ((pid * F.col("m.k")) % 41 - 20).cast("double") / F.lit(100.0)
    missing = (F.col("m.model") == "failed") | (pid % 53 == 0)
    yhat = F.when(missing, F.lit(None)).when(
        (pid + F.col("m.k")) % 59 == 0, F.lit(float("nan"))).when(
        pid % 29 == 0, F.lit(-5.0)).otherwise(
        F.col("price").cast("double") * (F.lit(1.0) + wobble))
    return exploded.select(pid, F.col("m.model").alias("model"),
                           F.col("price").alias("y"), yhat.alias("yhat"))


def experiment_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only experiment log: one run per part, metrics stored as text.

    `run_id` is the append position; 36 distinct configurations repeat, so
    full_name has duplicates and val_smape has ties (as the surveyed log).
    """
    part = read_table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    m = (k % 36).cast("string")
    return part.select(
        k.alias("run_id"),
        F.lit("v1_notok").alias("preprocessing"),
        F.lit("tfidf_5k_12").alias("vectorization"),
        F.concat(F.lit("GB_"), m).alias("model"),
        F.lit(True).alias("use_log"),
        (F.lit(20) + (k % 36) * 37 % 23).cast("string").alias("val_smape"),
        (F.lit(10) + k).cast("string").alias("train_time"),
        F.concat(F.lit("v1_notok|tfidf_5k_12|GB_"), m, F.lit("_log")).alias("full_name"),
    )


FIXTURES = {
    "products": products,
    "products_unpriced": products_unpriced,
    "products_large": products_large,
    "predictions": predictions,
    "experiment_log": experiment_log,
}
