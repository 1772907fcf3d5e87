"""Blends and weighted ensembles over the long prediction table.

Predictions of several models for one product meet through a single pivot
(`groupBy(product_id).pivot(model)`, one shuffle on the product key); blend
configurations are a generator over each wide row, and the metrics are a
partial-aggregating `groupBy(blend)`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nameprice.operators.metrics import clip_floor, mae, rmse, scored, smape

# FIXED VALUES: ridge weight of the blend with the tree configuration of that name
BLEND_RIDGE_WEIGHTS = {
    "light": 0.55, "deep": 0.50, "shallow": 0.60, "stable": 0.53, "wide": 0.48,
    "fast": 0.58, "regularized": 0.52, "balanced": 0.54, "ultra": 0.47,
    "extreme": 0.45, "lowlr": 0.40,
}


def wide_predictions(preds: DataFrame, models: list[str], floor: float = 1.0) -> DataFrame:
    """(product_id, y, <model>...) with each prediction clipped at `floor`."""
    return preds.groupBy("product_id").pivot("model", models).agg(
        F.first("y").alias("y"), F.first(clip_floor(F.col("yhat"), floor)).alias("p"))


def blend_grid(preds: DataFrame, base: str, partners: list[str],
               weights: dict[str, float] | None = None, floor: float = 1.0) -> DataFrame:
    """Metrics of w·base + (1−w)·partner: every named weight keeps its own partner, in the
    order of the two lists; fewer partners than weights take turns."""
    weights = weights or BLEND_RIDGE_WEIGHTS
    pairs = [(name, w, partners[i % len(partners)]) for i, (name, w) in enumerate(weights.items())]
    wide = wide_predictions(preds, [base] + sorted(set(partners)), floor)
    listed = F.explode(F.array(*[
        F.struct(F.lit(f"blend_{name}").alias("blend"), F.lit(float(w)).alias("w"),
                 F.lit(t).alias("partner"), F.col(f"{t}_p").alias("pt")) for name, w, t in pairs]))
    rows = wide.select(F.col(f"{base}_y").alias("y"), F.col(f"{base}_p").alias("pb"), listed.alias("c"))
    blended = F.col("c.w") * F.col("pb") + (F.lit(1.0) - F.col("c.w")) * F.col("c.pt")
    out = rows.select(F.col("c.blend").alias("blend"), F.col("c.w").alias("base_weight"),
                      F.col("c.partner").alias("partner"), "y", blended.alias("p"))
    return out.groupBy("blend", "base_weight", "partner").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(scored(F.col("y"), F.col("p"))).cast("bigint").alias("n_scored"),
        smape(F.col("y"), F.col("p"), None).alias("smape"),
        mae(F.col("y"), F.col("p")).alias("mae"),
        rmse(F.col("y"), F.col("p")).alias("rmse"))


def blend_predictions(preds: DataFrame, base: str, pairs: list[tuple[str, float, str]],
                      floor: float = 1.0) -> DataFrame:
    """Long predictions (product_id, model, split, y, yhat) of paired blends `blend_<name>`."""
    names = [base, *sorted({t for _, _, t in pairs})]
    p = clip_floor(F.col("yhat"), floor)
    wide = preds.groupBy("product_id", "split", "y").pivot("model", names).agg(F.first(p))
    listed = F.explode(F.array(*[F.struct(
        F.lit(f"blend_{name}").alias("model"),
        (F.lit(float(w)) * F.col(base) + F.lit(1.0 - w) * F.col(t)).alias("yhat"))
        for name, w, t in pairs]))
    return wide.select("product_id", "split", "y", listed.alias("b")).select(
        "product_id", "b.model", "split", "y", "b.yhat")


def weighted_top2(preds: DataFrame, ranking: DataFrame, metric: str = "val_smape",
                  weights: tuple[float, float] = (0.6, 0.4), floor: float = 0.0) -> DataFrame:
    """Ensemble of the two best models (by `metric`, ties by name), weights .6/.4.

    Models without a score are not ranked; a product that lacks one of the two
    predictions gets none.

    The ranking is a top-2 (TakeOrderedAndProject), so the broadcast side is
    two rows; the combination is one partial-aggregating groupBy(product_id).
    """
    usable = F.col(metric).isNotNull() & ~F.isnan(metric)
    order = [F.col(metric).asc(), F.col("model").asc()]
    top2 = ranking.where(usable).orderBy(*order).limit(2)
    # two rows: a global window over them is trivially small
    ranked = top2.select("model", F.row_number().over(Window.orderBy(*order)).alias("rank"))
    w = F.when(F.col("rank") == 1, F.lit(weights[0])).otherwise(F.lit(weights[1]))
    joined = preds.join(F.broadcast(ranked), "model")
    p = clip_floor(F.col("yhat"), floor)
    both = F.count(p) == 2          # a missing member leaves the ensemble missing
    return joined.groupBy("product_id").agg(
        F.first("y").alias("y"),
        F.when(both, F.sum(w * p)).alias("yhat"),
        F.max(F.when(F.col("rank") == 1, F.col("model"))).alias("model_1"),
        F.max(F.when(F.col("rank") == 2, F.col("model"))).alias("model_2"))
