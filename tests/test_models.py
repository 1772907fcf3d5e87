"""Model checks: ridge equals the closed form; trees beat a constant; repeatable."""

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from nameprice.operators import metrics, models


def _toy(spark, n=200, d=5, seed=3):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d))
    y = X @ rng.normal(size=d) + 2.0 + rng.normal(scale=0.1, size=n)
    rows = [(i, Vectors.dense(X[i].tolist()), float(y[i]), "train") for i in range(n)]
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

    schema = StructType([StructField("product_id", LongType()), StructField("features", VectorUDT()),
                         StructField("price", DoubleType()), StructField("split", StringType())])
    return X, y, spark.createDataFrame(rows, schema)


def test_ridge_matches_closed_form(spark):
    X, y, df = _toy(spark)
    alpha = 3.0
    preds, model, _ = models.fit_evaluate(models.ModelConfig("r", "ridge", {"alpha": alpha}), df,
                                          floor=-1e18)
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(X.shape[1]), Xc.T @ yc)
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-6)


def test_gbt_beats_constant_and_repeats(spark):
    X, y, df = _toy(spark)
    cfg = models.ModelConfig("g", "gbt", {"maxIter": 10, "maxDepth": 3})
    p1, _, _ = models.fit_evaluate(cfg, df, floor=-1e18)
    p2, _, _ = models.fit_evaluate(cfg, df, floor=-1e18)
    m = metrics.metrics_by(p1, ["model"], floor=-1e18).first()
    const = float(np.sqrt(np.mean((y - y.mean()) ** 2)))
    assert m["rmse"] < const
    assert p1.exceptAll(p2).count() == 0


def test_log_target_roundtrip(spark):
    df = spark.createDataFrame([(0,), (435,), (14176231,)], "p long")
    out = df.select(F.expm1(F.log1p(F.col("p").cast("double"))).alias("b"), "p").collect()
    for r in out:
        assert abs(r["b"] - r["p"]) < 1e-6 * max(1, r["p"])
