"""Regression metrics over a long prediction table, and their text forms.

A prediction table is long: (product_id, model, y, yhat[, split]). Every
metric is one `groupBy` with partial aggregation, so a model or split that
holds a third of the rows is still combined map-side before the shuffle.

A missing prediction (NULL or NaN) is not scored: every metric averages over the
scored rows, and `n` (rows) and `n_scored` are reported side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip_floor(c: Column, floor: float) -> Column:
    """greatest(c, floor); a missing value stays missing."""
    x = c.cast("double")
    return F.when(x.isNotNull(), F.greatest(x, F.lit(float(floor))))


def scored(y: Column, yhat: Column) -> Column:
    """True where both sides are numbers."""
    t, p = y.cast("double"), yhat.cast("double")
    return t.isNotNull() & p.isNotNull() & ~F.isnan(t) & ~F.isnan(p)


def smape_term(y: Column, yhat: Column, floor: float | None = 0.0) -> Column:
    """|y−p| / ((|y|+|p|)/2) with p clipped at `floor`; 0 when both are 0, NULL
    (skipped by `avg`) when either side is missing."""
    p = clip_floor(yhat, floor) if floor is not None else yhat.cast("double")
    t = y.cast("double")
    den = (F.abs(t) + F.abs(p)) / F.lit(2.0)
    term = F.when(den == 0, F.lit(0.0)).otherwise(F.abs(t - p) / den)
    return F.when(scored(t, p), term)


def smape(y: Column, yhat: Column, floor: float | None = 0.0) -> Column:
    """Aggregate: 100 · mean of the SMAPE terms."""
    return F.avg(smape_term(y, yhat, floor)) * F.lit(100.0)


def mae(y: Column, yhat: Column) -> Column:
    return F.avg(F.when(scored(y, yhat), F.abs(y.cast("double") - yhat.cast("double"))))


def rmse(y: Column, yhat: Column) -> Column:
    d = F.when(scored(y, yhat), y.cast("double") - yhat.cast("double"))
    return F.sqrt(F.avg(d * d))


def metrics_by(preds: DataFrame, keys: list[str], floor: float = 1.0,
               y: str = "y", yhat: str = "yhat") -> DataFrame:
    """SMAPE / MAE / RMSE of clipped predictions per key group."""
    p = clip_floor(F.col(yhat), floor)
    return preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(scored(F.col(y), p)).cast("bigint").alias("n_scored"),
        smape(F.col(y), p, None).alias("smape"),
        mae(F.col(y), p).alias("mae"),
        rmse(F.col(y), p).alias("rmse"),
    )


def model_comparison(preds: DataFrame, floor: float = 1.0) -> DataFrame:
    """One row per model: train/val SMAPE, val MAE/RMSE (split column required)."""
    m = metrics_by(preds, ["model", "split"], floor)
    return m.groupBy("model").agg(
        F.max(F.when(F.col("split") == "train", F.col("smape"))).alias("train_smape"),
        F.max(F.when(F.col("split") == "val", F.col("smape"))).alias("val_smape"),
        F.max(F.when(F.col("split") == "val", F.col("mae"))).alias("val_mae"),
        F.max(F.when(F.col("split") == "val", F.col("rmse"))).alias("val_rmse"),
    )


def metrics_long(comparison: DataFrame) -> DataFrame:
    """(model, metric, split, value): the JSON-sink form of the metric dictionary."""
    pairs = [("train_smape", "smape", "train"), ("val_smape", "smape", "val"),
             ("val_mae", "mae", "val"), ("val_rmse", "rmse", "val")]
    stacked = F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit(s).alias("split"),
                 F.col(c).cast("double").alias("value")) for c, m, s in pairs]))
    return comparison.select("model", stacked.alias("kv")).select(
        "model", "kv.metric", "kv.split", "kv.value")


def best_model(comparison: DataFrame, metric: str = "val_smape",
               order_col: str | None = None) -> DataFrame:
    """Arg-min with a deterministic tie rule (metric, then order column / name).

    A missing score (a failed run) never wins; without any score both are NULL.
    """
    tie = F.col(order_col) if order_col else F.col("model")
    score = F.col(metric)
    usable = score.isNotNull() & ~F.isnan(score)
    best = F.min(F.when(usable, F.struct(score.alias("s"), tie.alias("t"), F.col("model").alias("m"))))
    return comparison.agg(best.alias("b")).select(
        F.col("b.m").alias("best_model"), F.col("b.s").alias(metric))


def format_percent(c: Column, decimals: int = 2) -> Column:
    """f"{x:.2f}%" at the sink only; metrics stay DOUBLE inside the engine."""
    return F.format_string(f"%.{decimals}f%%", c)


def parse_percent(c: Column) -> Column:
    """'12.34%' → 12.34; unparsable text → NULL (never an error)."""
    return F.regexp_replace(F.trim(c), "%+$", "").try_cast("double")
