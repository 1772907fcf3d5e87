"""Missing values, restarts and early stopping: the cases the fixtures cannot show alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nameprice.operators import ensemble, metrics, models, validate
from nameprice.operators.quantiles import exact_quantiles
from nameprice.streaming import leaderboard as SL

NAN = float("nan")


def test_missing_predictions_are_not_scored(spark):
    df = spark.createDataFrame([("m", 100.0, None), ("m", 100.0, 100.0), ("m", 100.0, NAN)],
                               "model string, y double, yhat double")
    r = metrics.metrics_by(df, ["model"]).first()
    assert (r["n"], r["n_scored"], r["smape"], r["mae"], r["rmse"]) == (3, 1, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("scores,want", [
    ({"a": None, "b": 10.0, "c": 20.0}, ("b", 10.0)), ({"a": NAN, "b": 7.0}, ("b", 7.0)),
    ({"b": 5.0, "a": 5.0}, ("a", 5.0)), ({"a": None}, (None, None))])
def test_best_model_ignores_missing_scores(spark, scores, want):
    df = spark.createDataFrame(list(scores.items()), "model string, val_smape double")
    assert tuple(metrics.best_model(df).first()) == want


def test_top2_ensemble_needs_both_members(spark):
    preds = spark.createDataFrame(
        [(1, "a", 10.0, 10.0), (1, "b", 10.0, 20.0), (2, "a", 5.0, None), (2, "b", 5.0, 5.0),
         (1, "c", 10.0, 1.0), (2, "c", 5.0, 1.0)], "product_id long, model string, y double, yhat double")
    ranking = spark.createDataFrame([("c", None), ("a", 1.0), ("b", 2.0)],
                                    "model string, val_smape double")
    got = {r["product_id"]: r["yhat"] for r in ensemble.weighted_top2(preds, ranking).collect()}
    assert got == {1: 0.6 * 10 + 0.4 * 20, 2: None}


def test_blends_keep_their_pairs(spark):
    preds = spark.createDataFrame(
        [(1, "r", "val", 10.0, 10.0), (1, "s", "val", 10.0, 30.0), (1, "t", "val", 10.0, 50.0)],
        "product_id long, model string, split string, y double, yhat double")
    pairs = [("one", 0.5, "s"), ("two", 0.75, "t")]
    got = {r["model"]: r["yhat"] for r in ensemble.blend_predictions(preds, "r", pairs).collect()}
    assert got == {"blend_one": 20.0, "blend_two": 20.0}
    grid = {r["blend"]: (r["partner"], r["mae"]) for r in ensemble.blend_grid(
        preds, "r", ["s", "t"], {"one": 0.5, "two": 0.75}).collect()}
    assert grid == {"blend_one": ("s", 10.0), "blend_two": ("t", 10.0)}


def test_validation_finds_nan_prices(spark):
    template = spark.createDataFrame([("x",), ("y",)], "name string")
    good = spark.createDataFrame([("x", 1.0), ("y", 3.0)], "name string, price double")
    r = validate.validate_predictions(good, template).first()
    assert r["valid"] and r["messages"] == "" and r["median_price"] == 2.0
    bad = spark.createDataFrame([("x", NAN), ("y", -1.0), (None, None)], "name string, price double")
    r = validate.validate_predictions(bad, template).first()
    assert not r["valid"] and (r["nan_rows"], r["null_rows"], r["negative_rows"]) == (1, 1, 1)
    assert r["messages"].count(";") == 3 and r["max_price"] == -1.0


def test_exact_quantiles_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g in ("a", "b", None) for v in rng.normal(size=301).round(1)]
    rows += [("hot", 7.0)] * 500 + [("none", None)]
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r["q"] for r in exact_quantiles(df, "v", probs, ["g"]).collect()}
    assert set(got) == {"a", "b", None, "hot"}
    for g, q in got.items():
        own = [v for k, v in rows if k == g and v is not None]
        assert np.allclose(q, np.quantile(own, probs))
    assert exact_quantiles(df.where("g = 'none'"), "v", [0.5]).first()["q"] == [None]


def test_streaming_top_k_goes_on_after_a_restart(spark, tmp_path):
    def log(first):
        return spark.createDataFrame(
            [(i, "p", "v", "m", True, str(20 + i * 37 % 23), "1.0", f"n{i}") for i in range(first, first + 60)],
            "run_id long, preprocessing string, vectorization string, model string, use_log boolean, "
            "val_smape string, train_time string, full_name string")
    src, out = str(tmp_path / "log"), str(tmp_path / "top")
    SL.write_log_files(log(0), src, 3)
    SL.run_top_k(spark, src, out, 5)
    log(60).repartition(2).write.mode("append").option("header", True).csv(src)
    SL.run_top_k(spark, src, out, 5)
    got = [(r["val_smape"], r["run_id"]) for r in SL.run_top_k(spark, src, out, 5).collect()]
    every = sorted((20.0 + i * 37 % 23, i) for i in range(120))
    assert sorted(got) == every[:5]


def _signal(spark, n=400):
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(5)
    x = rng.uniform(size=(n, 4))
    y = np.exp(3 * x[:, 0] + 2 * (x[:, 1] > 0.5)) + 1
    rows = [(i, Vectors.dense(x[i].tolist()), float(y[i]), "val" if i % 5 == 0 else "train")
            for i in range(n)]
    df = spark.createDataFrame(rows, ["product_id", "features", "price", "split"])
    return df, y


def test_refit_uses_every_labelled_row(spark):
    df, _ = _signal(spark, 100)
    cfg = models.ModelConfig("r", "ridge", {"alpha": 0.1})
    open_rows = df.withColumn("price", F.when(F.col("product_id") < 90, F.col("price")))
    model = models.refit(cfg, open_rows)
    out = models.predict(cfg, model, open_rows.where("price is null"))
    assert out.count() == 10 and out.where("yhat < 1").count() == 0


def test_histogram_leaves_out_missing_values(spark):
    from nameprice.operators import profile
    df = spark.createDataFrame([(0.0,), (10.0,), (float("nan"),), (None,), (4.9,)], "x double")
    out = {r["bin"]: r for r in profile.histogram(df, F.col("x"), 10).collect()}
    assert {b: r["n"] for b, r in out.items()} == {0: 1, 4: 1, 9: 1} and out[9]["bin_hi"] == 10.0
    one = profile.histogram(df.where("x = 10"), F.col("x"), 10).first()
    assert (one["bin"], one["bin_lo"], one["bin_hi"], one["n"]) == (0, 10.0, 10.0, 1)
    assert profile.histogram(df.where("isnan(x) or x is null"), F.col("x"), 10).count() == 0
