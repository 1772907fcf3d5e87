"""Registered model queries (§2.D2, §2.K4, §2.M, §2.G3). Rows-only checks:
the fits are validated by pytest (closed form, beats-constant, determinism).

All fits share one checkpointed modelling frame per scale factor (q=10
stratified split, 5k word TF-IDF fitted on train + 31 features).
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nameprice.operators import boosting, ensemble, metrics, models, svd, validate
from nameprice.plans import grid, richflow
from nameprice.plans.modelframe import model_frame
from nameprice.plans.registry import register
from nameprice.session import checkpoint
from nameprice.sources import files
from nameprice.sources.tables import products_unpriced
from nameprice.streaming.leaderboard import scratch_dir

GB_100 = models.ModelConfig("GB_100_5_lr01_log", "gbt", {
    "maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 0.8}, True)


def _compare(spark, sf, cfgs: list[models.ModelConfig]) -> DataFrame:
    data, _ = model_frame(spark, sf)
    out = None
    for cfg in cfgs:
        preds, _, secs = models.fit_evaluate(cfg, data)
        row = metrics.model_comparison(preds).withColumn("train_time", F.lit(round(secs, 2)))
        out = row if out is None else out.unionByName(row)
    return out


@register("assemble_vectors")
def assemble_vectors(spark, sf):
    """hstack(TF-IDF sparse, 31 dense) per product: width and non-zeros."""
    data, names = model_frame(spark, sf)
    arr = vector_to_array("features")
    return data.select("product_id", "split", F.size(arr).alias("width"),
                       F.size(F.filter(arr, lambda x: x != 0)).alias("nnz"))


@register("model_ridge")
def model_ridge(spark, sf):
    """M1: ridge α=3 on raw price (TF-IDF + 31 features), floor-1 clip."""
    return _compare(spark, sf, [models.ModelConfig("ridge_a3", "ridge", {"alpha": 3.0})])


@register("ridge_sweep")
def ridge_sweep(spark, sf):
    """M2: ridge α ∈ {0.1, 1, 10, 50} in one fit; one comparison row per α, and the
    rounds that the slowest of them took to converge."""
    data, _ = model_frame(spark, sf)
    preds, model, secs = models.fit_evaluate_ridges(
        [models.ModelConfig(f"ridge_a{a:g}", "ridge", {"alpha": a}) for a in models.RIDGE_ALPHAS_SWEEP], data)
    return metrics.model_comparison(preds).withColumn("train_time", F.lit(round(secs, 2))) \
        .withColumn("rounds", F.lit(model.rounds))


@register("model_lasso")
def model_lasso(spark, sf):
    """M3: lasso α=1, up to 2000 iterations, raw price."""
    return _compare(spark, sf, [models.ModelConfig("lasso_a1", "lasso", {"alpha": 1.0})])


@register("model_elasticnet")
def model_elasticnet(spark, sf):
    """M4: elastic net α=1, l1 ratio .5 (library defaults), log price."""
    return _compare(spark, sf, [models.ModelConfig(
        "elasticnet_log", "elasticnet", {"alpha": 1.0, "l1_ratio": 0.5}, True)])


@register("model_random_forest")
def model_random_forest(spark, sf):
    """M5: random forest, 100 trees, depth 10, all features per split, log price."""
    return _compare(spark, sf, [models.ModelConfig("RF_100_10_log", "rf", {
        "numTrees": 100, "maxDepth": 10, "featureSubsetStrategy": "all"}, True)])


@register("model_gbt")
def model_gbt(spark, sf):
    """M6/M7: gradient boosting 100 trees, depth 5, rate .1, subsample .8, log price."""
    return _compare(spark, sf, [GB_100])


@register("feature_importance")
def feature_importance(spark, sf):
    """M16 + G3 + A5: gain and permutation importance of a 400-tree model on the dense
    matrix, by feature name; the 150 largest (top-k report) pass through the sink."""
    frame = richflow.cached_frame(spark, sf)
    config = boosting.BoostConfig("importance", 400, 0.05, 10, 63, 15, 0.5, held_share=0.1, patience=30)
    found = richflow.importances(frame, config).withColumnRenamed("gain", "importance")
    path = scratch_dir(spark, "importance")
    files.write_top_importance(found, path)
    return spark.read.schema("feature STRING, importance DOUBLE, permutation DOUBLE").option(
        "header", True).csv(path).orderBy(F.desc("importance"), F.asc("feature"))


def _scored_rows(spark, sf) -> DataFrame:
    """Choose the best model on the validation split, refit it on every labelled
    row and score the rows without a price; the predictions pass through the sink."""
    unpriced = products_unpriced(spark, sf)
    data, _ = model_frame(spark, sf, extra=unpriced)
    cfgs = {c.name: c for c in (
        models.ModelConfig("ridge_a3", "ridge", {"alpha": 3.0}),
        models.ModelConfig("RF_100_10_log", "rf", {
            "numTrees": 100, "maxDepth": 10, "featureSubsetStrategy": "all"}, True))}
    table = _compare(spark, sf, list(cfgs.values()))
    best = cfgs[metrics.best_model(table).first()["best_model"]]
    scored = models.predict(best, models.refit(best, data), data.where(F.col("split") == "score"))
    rows = checkpoint(scored.select("product_id", "name", F.col("yhat").alias("price")))
    path = scratch_dir(spark, "predictions")
    files.write_predictions(rows, path)
    written = spark.read.schema(files.PREDICTION_SCHEMA).option("header", True).option(
        "escape", '"').csv(path)
    report = validate.validate_predictions(written, unpriced).first()
    if not report["valid"]:
        raise ValueError(f"predictions are not valid: {report['messages']}")
    return rows


@register("predict_holdout")
def predict_holdout(spark, sf):
    """M15 + A3 + C8: (product_id, name, price) of every row without a price, by the best
    model refitted on all labelled rows; written, read back and validated."""
    return _scored_rows(spark, sf)


@register("predict_holdout_rows", """
select product_id, name, true as priced, true as at_least_floor from products_unpriced
""")
def predict_holdout_rows(spark, sf):
    """Every row without a price gets exactly one prediction, at or above the floor."""
    price = F.col("price")
    return _scored_rows(spark, sf).select(
        "product_id", "name", price.isNotNull().alias("priced"),
        F.coalesce(price >= 1.0, F.lit(False)).alias("at_least_floor"))


@register("svd_components")
def svd_components(spark, sf):
    """K4: uncentred truncated SVD of the TF-IDF rows of the train split, k = min(150,
    width − 1): singular values per component."""
    data, names = model_frame(spark, sf)
    k = max(1, min(150, len(names) - 31 - 1))
    found = svd.fit(data.where(F.col("split") == "train"), "tfidf", k)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(found.values)],
                                 "component int, singular_value double")


def _scores(spark, sf, column: str) -> DataFrame:
    frame = richflow.cached_frame(spark, sf)
    return frame.rows.select("product_id", frame.reductions[column].scores().alias("scores"))


@register("svd_scores_word")
def svd_scores_word(spark, sf):
    """K4: scores of every product on the (up to) 150 word components, signs fixed."""
    return _scores(spark, sf, "word").select("product_id", F.posexplode("scores").alias("component", "score"))


@register("svd_scores_char")
def svd_scores_char(spark, sf):
    """K4: scores of every product on the (up to) 100 character components, signs fixed."""
    return _scores(spark, sf, "char").select("product_id", F.posexplode("scores").alias("component", "score"))


def _boosted(spark, sf, kind: str, log_target: bool) -> DataFrame:
    labelled = richflow.cached_frame(spark, sf).rows.where("split <> 'score'")
    preds, fitted, secs = models.fit_evaluate_boosted(models.boost_configs()[kind], labelled, log_target)
    rounds = spark.createDataFrame([(n, m.kept, max(len(m.errors), m.kept))
                                    for n, m in fitted.items()], "m string, trees int, rounds int")
    return metrics.model_comparison(preds).join(F.broadcast(rounds), F.col("model") == F.col("m")).drop("m") \
        .withColumn("train_time", F.lit(round(secs, 2)))


@register("tuning_three_configs")
def tuning_three_configs(spark, sf):
    """M8: conservative / moderate / aggressive boosting configurations on raw price, grown
    together; comparison rows (pick the best with `best_model`)."""
    return _boosted(spark, sf, "three", False)


@register("hgb_config_sweep")
def hgb_config_sweep(spark, sf):
    """M9: the eleven boosting configurations on log price, each with its leaf limit, L2 term,
    held-out share and patience; grown together over one binned dense matrix."""
    return _boosted(spark, sf, "hgb", True)


@register("boosting_patience")
def boosting_patience(spark, sf):
    """M9: held-out error of the `fast` configuration after every round, and whether the
    round belongs to the model that was kept."""
    config = next(c for c in models.boost_configs()["hgb"] if c.name == "hist_gb_fast")
    labelled = richflow.cached_frame(spark, sf).rows.where("split = 'train'")
    model = boosting.fit(labelled, F.log1p(F.col("price").cast("double")), [config])[0]
    return spark.createDataFrame([(i + 1, float(e), i < len(model.trees)) for i, e in enumerate(model.errors)],
                                 "round int, held_out_error double, kept boolean")


@register("rich_comparison")
def rich_comparison(spark, sf):
    """M13 + M14 + E9: the feature-rich flow: ridge on word and character TF-IDF, eleven boosting
    models on the dense matrix, their eleven paired blends; `chosen` is the best."""
    return richflow.comparison(spark, sf)


_RICH_MODELS = [richflow.RIDGE.name, *[f"hist_gb_{n}" for n in models.HGB_CONFIGS],
                *[f"blend_{n}" for n in ensemble.BLEND_RIDGE_WEIGHTS]]


@register("rich_comparison_rows", " union all ".join(
    f"select '{m}' as model, count(*)::bigint as n_rows, true as has_error from products where price is not null"
    for m in _RICH_MODELS))
def rich_comparison_rows(spark, sf):
    """Every model and blend of the flow has a prediction for every labelled row, and
    an error on the validation split."""
    _, found = richflow.cached_flow(spark, sf)
    rows = found.predictions.groupBy("model").agg(F.count("yhat").alias("n_rows"))
    table = metrics.model_comparison(found.predictions).select(
        "model", F.col("val_smape").isNotNull().alias("has_error"))
    return rows.join(table, "model")


@register("rich_predictions", """
select product_id, name, true as priced, true as at_least_floor from products_unpriced
""")
def rich_predictions(spark, sf):
    """M14 + M15 + A3 + A6: the chosen model or blend, refitted (both members) on all labelled
    rows, scores every row without a price; files are written, read back and validated."""
    price = F.col("price")
    return richflow.predictions(spark, sf).select(
        "product_id", "name", price.isNotNull().alias("priced"),
        F.coalesce(price >= 1.0, F.lit(False)).alias("at_least_floor"))


@register("grid_search_small")
def grid_search_small(spark, sf):
    """M12 + A7: all text variants × all vectorisers × ridge, resumable, every run committed under
    its own key; returns the log read back, best first."""
    return grid.run_grid(spark, sf, grid.TEXT_VARIANTS, grid.VECTORIZERS,
                         [models.ModelConfig("ridge_a1", "ridge", {"alpha": 1.0})])


@register("grid_search_boosting")
def grid_search_boosting(spark, sf):
    """M6 + M12: the nine boosting models of the grid on its first text variant and vectoriser."""
    return grid.run_grid(spark, sf, grid.TEXT_VARIANTS[:1], grid.VECTORIZERS[:1],
                         boosted=models.boost_configs()["grid"])


@register("grid_search_rows", " union all ".join(
    f"select '{p}' as preprocessing, '{v}' as vectorization, 'ridge_a1' as model, true as has_error"
    for p, _, _ in grid.TEXT_VARIANTS for v, _, _ in grid.VECTORIZERS))
def grid_search_rows(spark, sf):
    """One committed run per cell of the ridge grid, each with an error."""
    return grid_search_small(spark, sf).select("preprocessing", "vectorization", "model",
                                               F.col("val_smape").isNotNull().alias("has_error"))
