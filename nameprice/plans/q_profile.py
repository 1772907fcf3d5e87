"""Registered profiling queries (§2.A scan, §2.B, §2.E1, §2.E8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nameprice.functions.categories import with_category_features
from nameprice.operators import metrics, profile
from nameprice.plans.registry import register
from nameprice.plans.sql_fragments import category_ctes
from nameprice.sources.files import with_stable_ids
from nameprice.sources.tables import products


@register("scan_products", """
select product_id, name, price from products
""")
def scan_products(spark, sf):
    """The training table as scanned: (product_id, name, price)."""
    return products(spark, sf)


@register("products_shape", """
select cast(count(*) as bigint) as n_rows, cast(3 as bigint) as n_cols from products
""")
def products_shape(spark, sf):
    df = products(spark, sf)
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols"))


@register("price_describe", """
select cast(count(price) as bigint) as count,
  cast(sum(price) as double) / count(price) as mean,
  stddev_samp(cast(price as double)) as std,
  cast(min(price) as double) as min,
  quantile_cont(cast(price as double), 0.25) as q25,
  quantile_cont(cast(price as double), 0.5) as median,
  quantile_cont(cast(price as double), 0.75) as q75,
  cast(max(price) as double) as max
from products
""", ["mean", "std", "min", "q25", "median", "q75", "max"])
def price_describe(spark, sf):
    return profile.describe(products(spark, sf), "price")


@register("null_counts", """
select 'product_id' as "column", cast(count(*) filter (where product_id is null) as bigint) as null_count from products
union all select 'name', cast(count(*) filter (where name is null) as bigint) from products
union all select 'price', cast(count(*) filter (where price is null) as bigint) from products
union all select '__total__', cast(count(*) filter (where product_id is null)
  + count(*) filter (where name is null) + count(*) filter (where price is null) as bigint) from products
""")
def null_counts(spark, sf):
    return profile.null_counts(products(spark, sf))


@register("duplicate_counts", """
select
  (select cast(coalesce(sum(c - 1), 0) as bigint)
     from (select count(*) as c from products group by name, price) g) as duplicate_rows,
  (select cast(coalesce(sum(c - 1), 0) as bigint)
     from (select count(*) as c from products group by name) g) as duplicate_names
""")
def duplicate_counts(spark, sf):
    return profile.duplicate_counts(products(spark, sf), ["name", "price"], "name")


_HIST_SQL = """
with v as (select {expr} as x from products where price is not null)
select bin,
  (select min(x) from v) + ((select max(x) from v) - (select min(x) from v)) * bin / 100.0 as bin_lo,
  (select min(x) from v) + ((select max(x) from v) - (select min(x) from v)) * (bin + 1) / 100.0 as bin_hi,
  n
from (
  select cast(case when (select max(x) from v) - (select min(x) from v) > 0
      then least(floor((x - (select min(x) from v))
                       / ((select max(x) from v) - (select min(x) from v)) * 100), 99)
      else 0 end as int) as bin,
    cast(count(*) as bigint) as n
  from v group by 1) h
"""


@register("price_histogram", _HIST_SQL.format(expr="cast(price as double)"),
          ["bin_lo", "bin_hi"])
def price_histogram(spark, sf):
    return profile.histogram(products(spark, sf), F.col("price"), 100)


@register("log_price_histogram", _HIST_SQL.format(expr="ln(1 + cast(price as double))"),
          ["bin_lo", "bin_hi"])
def log_price_histogram(spark, sf):
    return profile.histogram(products(spark, sf), F.log1p(F.col("price").cast("double")), 100)


@register("price_boxplot_stats", """
with v as (select cast(price as double) as x from products where price is not null),
q as (select quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as med,
             quantile_cont(x, 0.75) as q3 from v)
select q.q1 as q1, q.med as median, q.q3 as q3, q.q3 - q.q1 as iqr,
  (select min(x) from v where x >= q.q1 - 1.5 * (q.q3 - q.q1) and x <= q.q3 + 1.5 * (q.q3 - q.q1)) as whisker_low,
  (select max(x) from v where x >= q.q1 - 1.5 * (q.q3 - q.q1) and x <= q.q3 + 1.5 * (q.q3 - q.q1)) as whisker_high,
  (select cast(count(*) as bigint) from v where x < q.q1 - 1.5 * (q.q3 - q.q1) or x > q.q3 + 1.5 * (q.q3 - q.q1)) as outliers
from q
""", ["q1", "median", "q3", "iqr", "whisker_low", "whisker_high"])
def price_boxplot_stats(spark, sf):
    return profile.boxplot_stats(products(spark, sf), "price")


def _qcut_sql(q: int) -> str:
    probs = ", ".join(repr(i / q) for i in range(q + 1))
    return f"""
select product_id, price,
  cast(greatest(len(list_filter(
    (select list_distinct(quantile_cont(cast(price as double), [{probs}])) from products),
    lambda e: e < cast(price as double))) - 1, 0) as int) as price_bin
from products
"""


@register("price_quantile_bins", _qcut_sql(10))
def price_quantile_bins(spark, sf):
    """q=10 stratification bins (pd.qcut, duplicate edges dropped)."""
    return profile.quantile_bins(products(spark, sf).select("product_id", "price"),
                                 "price", 10)


@register("price_quantile_bins_q20", _qcut_sql(20))
def price_quantile_bins_q20(spark, sf):
    return profile.quantile_bins(products(spark, sf).select("product_id", "price"),
                                 "price", 20)


@register("category_price_summary", "with " + category_ctes("products") + """
select f.primary_category, cast(count(p.price) as bigint) as count,
  cast(sum(p.price) as double) / count(p.price) as mean,
  quantile_cont(cast(p.price as double), 0.5) as median,
  stddev_samp(cast(p.price as double)) as std,
  cast(min(p.price) as double) as min, cast(max(p.price) as double) as max
from products p join cat_final f using (product_id)
group by f.primary_category
""", ["mean", "median", "std", "min", "max"])
def category_price_summary(spark, sf):
    """Flagship: primary keyword category → price count/mean/median/std/min/max."""
    feats = with_category_features(products(spark, sf))
    return profile.category_price_summary(feats, "primary_category", "price")


def _pred_hist_sql(series: str, expr: str, known: str) -> str:
    return _HIST_SQL.replace(
        "with v as (select {expr} as x from products where price is not null)",
        f"with v as (select {expr} as x from predictions where model = 'ridge' and {known})").replace(
        "select bin,", f"select '{series}' as series, bin,", 1)


@register("prediction_histogram",
          "select * from (" + _pred_hist_sql("actual", "cast(y as double)", "y is not null")
          + ") a union all select * from (" + _pred_hist_sql(
              "predicted", "greatest(yhat, 0.0)", "yhat is not null and not isnan(yhat)")
          + ") p", ["bin_lo", "bin_hi"])
def prediction_histogram(spark, sf):
    """Actual vs predicted (clipped at 0) price histograms of the ridge model,
    100 equal-width bins each."""
    from nameprice.sources.tables import predictions

    p = predictions(spark, sf).where(F.col("model") == "ridge")
    actual = profile.histogram(p, F.col("y"), 100).select(F.lit("actual").alias("series"), "*")
    pred = profile.histogram(p, metrics.clip_floor(F.col("yhat"), 0.0), 100).select(
        F.lit("predicted").alias("series"), "*")
    return actual.unionByName(pred)


@register("scan_products_csv", "select name, price from products")
def scan_products_csv(spark, sf):
    """A1: the price table landed as header CSV (quoted, multi-line-safe) in the
    shared folder and scanned back with a declared schema (no inference)."""
    from nameprice.sources import files
    from nameprice.streaming.leaderboard import scratch_dir

    path = scratch_dir(spark, "train-csv")
    products(spark, sf).select("name", "price").write.option("header", True).csv(path)
    return files.read_price_csv(spark, path).select("name", "price")


@register("stable_row_ids", """
select md5(concat_ws(',', coalesce(length(name) || ':' || name, 'null'),
                     coalesce(length(cast(price as varchar)) || ':' || cast(price as varchar), 'null'),
                     cast(row_number() over (partition by name, price) - 1 as varchar))) as product_id,
  name, price
from products
""")
def stable_row_ids(spark, sf):
    """A1: rows of the price table with ids that do not depend on files or order."""
    return with_stable_ids(products(spark, sf).select("name", "price"))
