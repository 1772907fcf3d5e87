"""Registered streaming queries (§2.N): each lands its input (derived by Spark
from the driver tables) as several files under the shared checkpoint folder,
drains it with Trigger.AvailableNow, and must equal its batch counterpart."""

from __future__ import annotations

from nameprice.functions import features as FT
from nameprice.plans import sql_features as SF
from nameprice.plans.registry import register
from nameprice.sources.tables import experiment_log, products
from nameprice.streaming import features as SFE
from nameprice.streaming import leaderboard as SL

_STATS_SQL = """
select cast(count(*) as bigint) as runs, min(v) as best_smape, max(v) as worst_smape,
  avg(v) as mean_smape,
  cast(count(*) filter (where v < 40) as bigint) as under_40,
  cast(count(*) filter (where v < 30) as bigint) as under_30,
  cast(count(*) filter (where v < 25) as bigint) as under_25
from (select try_cast(val_smape as double) as v from experiment_log) l
"""


@register("stream_leaderboard", _STATS_SQL, ["best_smape", "worst_smape", "mean_smape"])
def stream_leaderboard(spark, sf):
    """Running best/worst/mean/thresholds over a streamed experiment log."""
    src = SL.scratch_dir(spark, "log")
    SL.write_log_files(experiment_log(spark, sf), src, 4)
    return SL.run_stats(spark, src, SL.scratch_dir(spark, "stats"))


@register("stream_leaderboard_latest", """
select cast(count(*) as bigint) as runs, min(v) as best_smape, max(v) as worst_smape,
  avg(v) as mean_smape,
  cast(count(*) filter (where v < 40) as bigint) as under_40,
  cast(count(*) filter (where v < 30) as bigint) as under_30,
  cast(count(*) filter (where v < 25) as bigint) as under_25
from (select try_cast(val_smape as double) as v from experiment_log l
      where run_id = (select max(m.run_id) from experiment_log m where m.full_name = l.full_name)) l
""", ["best_smape", "worst_smape", "mean_smape"])
def stream_leaderboard_latest(spark, sf):
    """Statistics of the latest run per full_name over a streamed log."""
    src = SL.scratch_dir(spark, "log")
    SL.write_log_files(experiment_log(spark, sf), src, 4)
    return SL.run_latest_stats(spark, src, SL.scratch_dir(spark, "latest"))


@register("stream_leaderboard_topk", """
select run_id, full_name, try_cast(val_smape as double) as val_smape,
  try_cast(train_time as double) as train_time
from experiment_log order by 3 nulls last, run_id limit 5
""", ["val_smape", "train_time"])
def stream_leaderboard_topk(spark, sf):
    """The five best runs so far, merged micro-batch by micro-batch."""
    src = SL.scratch_dir(spark, "log")
    SL.write_log_files(experiment_log(spark, sf), src, 4)
    return SL.run_top_k(spark, src, SL.scratch_dir(spark, "top"), 5)


@register("stream_features_basic31", SF.basic31_sql(),
          [c for c in ("max_num", "min_num", "sum_num", "mean_num", "first_num")])
def stream_features_basic31(spark, sf):
    """The 31 features computed on a product stream (equals the batch query)."""
    src = SL.scratch_dir(spark, "products")
    products(spark, sf).repartition(4).write.parquet(src)
    out = SFE.run_features(spark, src, SL.scratch_dir(spark, "features"))
    return out.select("product_id", *FT.BASIC31_COLUMNS)

