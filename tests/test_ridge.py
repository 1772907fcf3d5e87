"""Ridge by conjugate gradients: the closed form on the real frame, several systems at once."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from nameprice.operators import metrics, models, ridge
from nameprice.plans.modelframe import model_frame

SF = "/root/testdata/sf0.001"


def closed_form(X, y, alpha):
    mean, y_mean = X.mean(0), y.mean()
    C = X - mean
    w = np.linalg.solve(C.T @ C + alpha * np.eye(X.shape[1]), C.T @ (y - y_mean))
    return w, y_mean - mean @ w


@pytest.fixture(scope="module")
def frame(spark):
    data, _ = model_frame(spark, SF)
    rows = data.select("product_id", "split", "price", vector_to_array("features").alias("x")) \
        .orderBy("product_id").toPandas()
    return data, rows, np.array(rows["x"].tolist())


def test_equals_closed_form_on_the_model_frame(frame):
    data, rows, X = frame
    train = (rows["split"] == "train").to_numpy()
    price = rows["price"].to_numpy(dtype=float)
    y = F.col("price").cast("double")
    systems = [(a, t) for a in (0.1, 1.0, 3.0, 50.0) for t in (y, F.log1p(y))]
    model = ridge.fit(data.where("split = 'train'"), systems)
    found = data.select("product_id", model.predictions().alias("p")).orderBy("product_id").toPandas()
    found = np.array(found["p"].tolist())
    for i, (alpha, target) in enumerate(systems):
        own = np.log1p(price) if i % 2 else price
        w, b = closed_form(X[train], own[train], alpha)
        wanted = X @ w + b
        assert np.abs(found[:, i] - wanted).max() <= 1e-6 * np.abs(wanted).max()


def test_single_model_and_sweep_agree(frame):
    data, _, _ = frame
    cfgs = [models.ModelConfig(f"r{a}", "ridge", {"alpha": a}) for a in (0.1, 3.0)]
    many, _, _ = models.fit_evaluate_ridges(cfgs, data)
    one, _, _ = models.fit_evaluate(cfgs[1], data)
    a = many.where("model = 'r3.0'").orderBy("product_id").toPandas()
    b = one.orderBy("product_id").toPandas()
    assert list(a["product_id"]) == list(b["product_id"])
    assert np.allclose(a["yhat"], b["yhat"], rtol=1e-6)
    assert metrics.model_comparison(many).count() == 2


def test_dense_rows_flat_features_and_missing_targets(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(60, 4)) * [1.0, 1000.0, 1e-3, 0.0] + [0.0, 0.0, 0.0, 7.0]
    y = X @ [1.0, 0.01, 50.0, 3.0] + rng.normal(size=60)
    rows = [(Vectors.dense(x) if i % 2 else Vectors.sparse(4, [(j, v) for j, v in enumerate(x) if v]),
             float(t)) for i, (x, t) in enumerate(zip(X.tolist(), y))]
    data = spark.createDataFrame([*rows, (Vectors.dense([9.0] * 4), None)], ["features", "price"])
    model = ridge.fit(data, [(0.5, F.col("price"))])
    w, b = closed_form(X, y, 0.5)
    assert np.allclose(model.coefficients.toArray()[:3], w[:3], rtol=1e-7)
    assert model.coefficients.toArray()[3] == 0.0
    assert abs(model.intercept - (b + 7.0 * w[3])) < 1e-6


def test_no_rows(spark):
    data = spark.createDataFrame([(Vectors.dense([1.0]), 1.0)], ["features", "price"]).where("price > 2")
    with pytest.raises(ValueError):
        ridge.fit(data, [(1.0, F.col("price"))])
    with pytest.raises(ValueError):
        ridge.fit(data, [(0.0, F.col("price"))])


def test_blocks_of_one_task_are_solved_without_a_job_a_round(spark, monkeypatch):
    rng = np.random.default_rng(9)
    X = np.where(rng.random((300, 40)) < 0.2, rng.uniform(1, 2, (300, 40)), 0) * rng.uniform(0.1, 30, 40)
    y = X @ rng.normal(size=40) + rng.normal(size=300)
    data = spark.createDataFrame([(Vectors.dense(x), float(t)) for x, t in zip(X.tolist(), y)], ["features", "price"])
    systems = [(0.5, F.col("price")), (3.0, F.col("price") * 2 + 1)]
    monkeypatch.setattr(ridge, "HEAVY", 4)
    found = []
    for group, most in (("alone", ridge.TASK_ENTRIES), ("rounds", 0)):
        monkeypatch.setattr(ridge, "TASK_ENTRIES", most)
        spark.sparkContext.setJobGroup(group, group)
        model = ridge.fit(data.repartition(3), systems)
        found.append((model, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))))
    spark.sparkContext.setJobGroup("other", "other")
    (alone, few), (spread, many) = found
    assert few < 12 < spread.rounds < many
    for i, (alpha, target) in enumerate(((0.5, y), (3.0, 2 * y + 1))):
        w, b = closed_form(X, target, alpha)
        assert np.allclose(alone.weights[:, i], w) and np.allclose(spread.weights[:, i], w)
        assert abs(alone.intercepts[i] - b) < 1e-6
