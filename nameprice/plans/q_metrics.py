"""Registered metric, validation, leaderboard, blend and split queries
(§2.C, §2.D3–D4, §2.E2–E9, §2.G4–G7, §2.L, §2.M13–M14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nameprice.operators import ensemble, leaderboard, metrics, split, validate
from nameprice.operators.quantiles import exact_quantiles
from nameprice.plans.registry import register
from nameprice.sources.tables import experiment_log, predictions, products

MD5_BUCKET_SQL = "(('0x' || substr(md5(cast(product_id as varchar)), 1, 8))::bigint % 100)"
MD5_KEY_SQL = "('0x' || substr(md5(cast(product_id as varchar)), 1, 15))::bigint"


def _clip_sql(floor: str) -> str:
    """Clipped prediction; NULL where it is missing or not a number."""
    return f"(case when yhat is null or isnan(yhat) then null else greatest(yhat, {floor}) end)"


def _smape_sql(floor: str) -> str:
    p = _clip_sql(floor)
    return (f"100.0 * avg(case when (abs(cast(y as double)) + abs({p})) / 2.0 = 0 then 0.0 "
            f"else abs(cast(y as double) - {p}) / ((abs(cast(y as double)) + abs({p})) / 2.0) end)")


@register("metrics_smape_floor0", f"""
select model, cast(count(*) as bigint) as n, {_smape_sql('0.0')} as smape
from predictions group by model
""", ["smape"])
def metrics_smape_floor0(spark, sf):
    """E2 + C2 + D3: SMAPE with predictions clipped at 0, per model."""
    p = predictions(spark, sf)
    return p.groupBy("model").agg(F.count(F.lit(1)).alias("n"),
                                  metrics.smape(F.col("y"), F.col("yhat"), 0.0).alias("smape"))


@register("metrics_smape_floor1", f"""
select model, cast(count(*) as bigint) as n, {_smape_sql('1.0')} as smape
from predictions group by model
""", ["smape"])
def metrics_smape_floor1(spark, sf):
    """E3 + C3: SMAPE with predictions clipped at 1, per model."""
    p = predictions(spark, sf)
    return p.groupBy("model").agg(F.count(F.lit(1)).alias("n"),
                                  metrics.smape(F.col("y"), F.col("yhat"), 1.0).alias("smape"))


@register("metrics_mae_rmse", """
select model, cast(count(*) as bigint) as n, cast(count(p) as bigint) as n_scored,
  avg(abs(cast(y as double) - p)) as mae,
  sqrt(avg((cast(y as double) - p) * (cast(y as double) - p))) as rmse
from (select *, """ + _clip_sql("1.0") + """ as p from predictions) s group by model
""", ["mae", "rmse"])
def metrics_mae_rmse(spark, sf):
    m = metrics.metrics_by(predictions(spark, sf), ["model"], floor=1.0)
    return m.select("model", "n", "n_scored", "mae", "rmse")


def _comparison(spark, sf):
    preds = split.split_random(predictions(spark, sf), "product_id", 20)
    return metrics.model_comparison(preds, floor=1.0)


_COMPARISON_SQL = f"""
with s as (select *, case when {MD5_BUCKET_SQL} < 20 then 'val' else 'train' end as split,
    {_clip_sql("1.0")} as p from predictions),
m as (select model, split,
    100.0 * avg(case when (abs(cast(y as double)) + abs(p)) / 2.0 = 0 then 0.0
        else abs(cast(y as double) - p) / ((abs(cast(y as double)) + abs(p)) / 2.0) end) as smape,
    avg(abs(cast(y as double) - p)) as mae,
    sqrt(avg((cast(y as double) - p) * (cast(y as double) - p))) as rmse
  from s group by model, split)
select model,
  max(case when split = 'train' then smape end) as train_smape,
  max(case when split = 'val' then smape end) as val_smape,
  max(case when split = 'val' then mae end) as val_mae,
  max(case when split = 'val' then rmse end) as val_rmse
from m group by model
"""


@register("model_comparison", _COMPARISON_SQL,
          ["train_smape", "val_smape", "val_mae", "val_rmse"])
def model_comparison(spark, sf):
    """One row per model, train/val SMAPE and val MAE/RMSE on the 80/20 split."""
    return _comparison(spark, sf)


@register("metrics_long", f"""
with c as ({_COMPARISON_SQL})
select model, 'smape' as metric, 'train' as split, train_smape as value from c
union all select model, 'smape', 'val', val_smape from c
union all select model, 'mae', 'val', val_mae from c
union all select model, 'rmse', 'val', val_rmse from c
""", ["value"])
def metrics_long_q(spark, sf):
    """Long (model, metric, split, value) table behind the metrics JSON."""
    return metrics.metrics_long(_comparison(spark, sf))


@register("best_model", f"""
with c as ({_COMPARISON_SQL})
select model as best_model, val_smape from c where val_smape is not null
order by val_smape, model limit 1
""", ["val_smape"])
def best_model(spark, sf):
    """Arg-min validation SMAPE; ties go to the first model name."""
    return metrics.best_model(_comparison(spark, sf), "val_smape")


@register("prediction_stats", f"""
select model, cast(count(*) as bigint) as n, cast(count(p) as bigint) as n_scored,
  min(p) as min, max(p) as max, avg(p) as mean, quantile_cont(p, 0.5) as median
from (select model, {_clip_sql("0.0")} as p from predictions) s group by model
""", ["min", "max", "mean", "median"])
def prediction_stats(spark, sf):
    """min/max/mean/median of the clipped predictions per model."""
    number = F.when(~F.isnan("yhat"), F.col("yhat"))
    p = predictions(spark, sf).withColumn("p", metrics.clip_floor(number, 0.0))
    base = p.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.count("p").alias("n_scored"), F.min("p").alias("min"),
        F.max("p").alias("max"), F.avg("p").alias("mean"))
    med = exact_quantiles(p, "p", [0.5], ["model"]).select("model", F.col("q")[0].alias("median"))
    return base.join(med, "model", "left")


@register("validate_predictions", """
with sub as (select pr.name as name, d.yhat as price
             from products pr join predictions d on pr.product_id = d.product_id
             where d.model = 'ridge')
select true as columns_ok, n_rows, expected_rows, n_rows = expected_rows as row_count_ok,
  null_rows, nan_rows, negative_rows, min_price, max_price, mean_price, median_price, messages,
  messages = '' as valid
from (select *, concat_ws('; ',
    case when n_rows <> expected_rows then 'row count differs from the template' end,
    case when null_rows > 0 then 'missing values' end,
    case when nan_rows > 0 then 'prices that are not numbers' end,
    case when negative_rows > 0 then 'negative prices' end) as messages
  from (select cast(count(*) as bigint) as n_rows,
    (select cast(count(*) as bigint) from products) as expected_rows,
    cast(count(*) filter (where name is null or price is null) as bigint) as null_rows,
    cast(count(*) filter (where isnan(price)) as bigint) as nan_rows,
    cast(count(*) filter (where not isnan(price) and price < 0) as bigint) as negative_rows,
    min(price) filter (where not isnan(price)) as min_price,
    max(price) filter (where not isnan(price)) as max_price,
    avg(price) filter (where not isnan(price)) as mean_price,
    quantile_cont(price, 0.5) filter (where not isnan(price)) as median_price from sub) as c) as m
""", ["min_price", "max_price", "mean_price", "median_price"])
def validate_predictions(spark, sf):
    """(name, price) prediction file of the ridge model vs the products template."""
    pr = products(spark, sf)
    d = predictions(spark, sf, pr).where(F.col("model") == "ridge")
    sub = pr.join(d, "product_id").select("name", F.col("yhat").alias("price"))
    return validate.validate_predictions(sub, pr)


_TYPED_LOG_SQL = """
select run_id, full_name, try_cast(val_smape as double) as val_smape,
  try_cast(train_time as double) as train_time from experiment_log
"""


@register("leaderboard_stats", f"""
select cast(count(*) as bigint) as runs, min(val_smape) as best_smape, max(val_smape) as worst_smape,
  avg(val_smape) as mean_smape,
  cast(count(*) filter (where val_smape < 40) as bigint) as under_40,
  cast(count(*) filter (where val_smape < 30) as bigint) as under_30,
  cast(count(*) filter (where val_smape < 25) as bigint) as under_25
from ({_TYPED_LOG_SQL}) l
""", ["best_smape", "worst_smape", "mean_smape"])
def leaderboard_stats(spark, sf):
    """E7 + C7: best/worst/mean and threshold counts over the experiment log."""
    return leaderboard.stats(leaderboard.typed_log(experiment_log(spark, sf)))


@register("leaderboard_latest_stats", f"""
with l as ({_TYPED_LOG_SQL}),
k as (select full_name, max(run_id) as run_id from l group by full_name)
select cast(count(*) as bigint) as runs, min(val_smape) as best_smape, max(val_smape) as worst_smape,
  avg(val_smape) as mean_smape,
  cast(count(*) filter (where val_smape < 40) as bigint) as under_40,
  cast(count(*) filter (where val_smape < 30) as bigint) as under_30,
  cast(count(*) filter (where val_smape < 25) as bigint) as under_25
from l semi join k using (full_name, run_id)
""", ["best_smape", "worst_smape", "mean_smape"])
def leaderboard_latest_stats(spark, sf):
    """Q7 option: the leaderboard over the latest run of each configuration."""
    log = leaderboard.typed_log(experiment_log(spark, sf))
    return leaderboard.stats(leaderboard.latest_only(log))


@register("leaderboard_topk", f"""
select run_id, full_name, val_smape, train_time
from ({_TYPED_LOG_SQL}) l order by val_smape nulls last, run_id limit 5
""", ["val_smape", "train_time"])
def leaderboard_topk(spark, sf):
    """A2 + G4: text metrics cast on read, five smallest val_smape."""
    return leaderboard.top_k(leaderboard.typed_log(experiment_log(spark, sf)), 5)


@register("leaderboard_top10", f"""
select run_id, full_name, val_smape, train_time
from ({_TYPED_LOG_SQL}) l order by val_smape nulls last, run_id limit 10
""", ["val_smape", "train_time"])
def leaderboard_top10(spark, sf):
    return leaderboard.top_k(leaderboard.typed_log(experiment_log(spark, sf)), 10)


@register("metric_text_roundtrip", """
select run_id, printf('%.2f%%', try_cast(val_smape as double)) as smape_text,
  try_cast(rtrim(trim(printf('%.2f%%', try_cast(val_smape as double))), '%') as double) as smape_parsed
from experiment_log
""", ["smape_parsed"])
def metric_text_roundtrip(spark, sf):
    """DOUBLE → '12.34%' text at the sink and back."""
    log = leaderboard.typed_log(experiment_log(spark, sf))
    text = metrics.format_percent(F.col("val_smape"))
    return log.select("run_id", text.alias("smape_text"),
                      metrics.parse_percent(text).alias("smape_parsed"))


@register("log_price_roundtrip", """
select product_id, price, ln(1 + cast(price as double)) as log_price,
  exp(ln(1 + cast(price as double))) - 1 as price_back
from products
""", ["log_price", "price_back"])
def log_price_roundtrip(spark, sf):
    """C4: log1p target transform and expm1 inverse."""
    p = products(spark, sf)
    lp = F.log1p(F.col("price").cast("double"))
    return p.select("product_id", "price", lp.alias("log_price"), F.expm1(lp).alias("price_back"))


# each blend keeps its own partner: the two pseudo-trees take turns
BLEND_PAIRS = [(name, w, ("tree_a", "tree_b")[i % 2])
               for i, (name, w) in enumerate(ensemble.BLEND_RIDGE_WEIGHTS.items())]


def _blend_sql() -> str:
    rows = [f"('blend_{name}', cast({w!r} as double), '{t}')" for name, w, t in BLEND_PAIRS]
    return f"""
with w as (select product_id, max(y) as y,
    max(case when model = 'ridge' then p end) as ridge,
    max(case when model = 'tree_a' then p end) as tree_a,
    max(case when model = 'tree_b' then p end) as tree_b
  from (select *, {_clip_sql("1.0")} as p from predictions) s group by product_id),
c(blend, base_weight, partner) as (values {", ".join(rows)}),
b as (select c.blend, c.base_weight, c.partner, cast(w.y as double) as y,
    c.base_weight * w.ridge + (1.0 - c.base_weight)
      * (case when c.partner = 'tree_a' then w.tree_a else w.tree_b end) as p
  from c join w on true)
select blend, base_weight, partner, cast(count(*) as bigint) as n, cast(count(p) as bigint) as n_scored,
  100.0 * avg(case when (abs(y) + abs(p)) / 2.0 = 0 then 0.0 else abs(y - p) / ((abs(y) + abs(p)) / 2.0) end) as smape,
  avg(abs(y - p)) as mae, sqrt(avg((y - p) * (y - p))) as rmse
from b group by blend, base_weight, partner
"""


@register("blend_grid", _blend_sql(),
          {"base_weight": 6, "smape": 6, "mae": 4, "rmse": 4})
def blend_grid(spark, sf):
    """M13 + D4: eleven ridge + tree blends, each weight with its own partner."""
    return ensemble.blend_grid(predictions(spark, sf), "ridge", ["tree_a", "tree_b"])


@register("ensemble_top2", f"""
with c as ({_COMPARISON_SQL}),
t as (select model, row_number() over (order by val_smape, model) as rk from c
      where val_smape is not null order by val_smape, model limit 2),
e as (select d.product_id, max(d.y) as y,
    case when count(p) = 2 then sum(case when t.rk = 1 then 0.6 else 0.4 end * p) end as yhat
  from (select *, {_clip_sql("0.0")} as p from predictions) d join t on d.model = t.model
  group by d.product_id)
select (select model from t where rk = 1) as model_1, (select model from t where rk = 2) as model_2,
  cast(count(*) as bigint) as n,
  100.0 * avg(case when (abs(cast(y as double)) + abs(yhat)) / 2.0 = 0 then 0.0
      else abs(cast(y as double) - yhat) / ((abs(cast(y as double)) + abs(yhat)) / 2.0) end) as smape
from e
""", ["smape"])
def ensemble_top2(spark, sf):
    """M14 + G6: .6/.4 ensemble of the two best models after clipping at 0."""
    preds = predictions(spark, sf)
    ens = ensemble.weighted_top2(preds, _comparison(spark, sf), "val_smape", (0.6, 0.4), 0.0)
    return ens.groupBy("model_1", "model_2").agg(
        F.count(F.lit(1)).alias("n"),
        metrics.smape(F.col("y"), F.col("yhat"), None).alias("smape"))


@register("split_random", f"""
select product_id, case when {MD5_BUCKET_SQL} < 20 then 'val' else 'train' end as split
from products
""")
def split_random(spark, sf):
    """L1: deterministic 80/20 md5-bucket split."""
    return split.split_random(products(spark, sf), "product_id", 20).select("product_id", "split")


def _stratified_sql(q: int) -> str:
    probs = ", ".join(repr(i / q) for i in range(q + 1))
    return f"""
with b as (select product_id, price,
    cast(greatest(len(list_filter(
      (select list_distinct(quantile_cont(cast(price as double), [{probs}])) from products),
      lambda e: e < cast(price as double))) - 1, 0) as int) as stratum
  from products),
r as (select *, row_number() over (partition by stratum order by {MD5_KEY_SQL}, product_id) as rn,
    count(*) over (partition by stratum) as n from b)
select product_id, price, stratum,
  case when rn <= (n * 15 + 99) // 100 then 'val' else 'train' end as split
from r
"""


@register("split_stratified", _stratified_sql(10))
def split_stratified(spark, sf):
    """L3 + C9: exact 15 % per q=10 price stratum (radix-selected cut per stratum)."""
    p = products(spark, sf).select("product_id", "price")
    return split.split_stratified(p, "product_id", "price", 10, 15)


@register("split_stratified_q20", _stratified_sql(20))
def split_stratified_q20(spark, sf):
    p = products(spark, sf).select("product_id", "price")
    return split.split_stratified(p, "product_id", "price", 20, 15)


@register("split_random_85_15", f"""
select product_id, case when {MD5_BUCKET_SQL} < 15 then 'val' else 'train' end as split
from products
""")
def split_random_85_15(spark, sf):
    """L2: deterministic 85/15 md5-bucket split."""
    return split.split_random(products(spark, sf), "product_id", 15).select("product_id", "split")
