"""Metric and binning goldens (FIXTURES.md §5)."""

from pyspark.sql import functions as F

from nameprice.operators import metrics, profile


def _smape(spark, ys, ps, floor):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(ys, ps)], "y double, p double")
    return df.agg(metrics.smape(F.col("y"), F.col("p"), floor)).first()[0]


def test_smape_example(spark):
    assert abs(_smape(spark, [100, 200, 150], [110, 190, 150], 0.0) - 4.8840048840) < 1e-9


def test_smape_floors(spark):
    assert _smape(spark, [0.0], [0.0], 0.0) == 0.0
    assert _smape(spark, [0.0], [0.0], 1.0) == 200.0
    assert _smape(spark, [10.0], [-5.0], 0.0) == 200.0


def test_smape_bounds(spark):
    v = _smape(spark, [1, 5, 1000, 3], [1000, 0, 1, 3], 0.0)
    assert 0.0 <= v <= 200.0


def test_qcut_bins(spark):
    prices = [0, 0, 0, 5, 9, 10, 10, 10, 12, 50, 99, 99, 435, 435, 1000, 3000, 14176231]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(prices)], "id long, price long")
    got = [r["b"] for r in profile.quantile_bins(df, "price", 10, "b").orderBy("id").collect()]
    assert got == [0, 0, 0, 0, 1, 2, 2, 2, 3, 4, 5, 5, 6, 6, 7, 8, 8]


def test_percent_text_roundtrip(spark):
    df = spark.createDataFrame([(12.345,), (None,)], "x double")
    out = df.select(metrics.format_percent(F.col("x")).alias("t")) \
        .select("t", metrics.parse_percent(F.col("t")).alias("v")).collect()
    assert out[0]["t"] == "12.35%" and abs(out[0]["v"] - 12.35) < 1e-12
    assert out[1]["v"] is None
