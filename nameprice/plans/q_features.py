"""Registered feature-family queries (§2.J)."""

from __future__ import annotations

from nameprice.functions.categories import CATEGORY_COLUMNS, with_category_features
from nameprice.plans.registry import register
from nameprice.plans.sql_fragments import (
    CATEGORY_DOUBLE_COLS, category_ctes, category_feature_select)
from nameprice.session import checkpoint
from nameprice.sources.tables import products


@register("features_categories", "with " + category_ctes("products") + """
select s.product_id, """ + category_feature_select() + """
from cat_scores s join cat_final f using (product_id)
""", CATEGORY_DOUBLE_COLS)
def features_categories(spark, sf):
    """23 keyword scores, 23 flags, entropy, primary/secondary category."""
    return with_category_features(products(spark, sf)).select("product_id", *CATEGORY_COLUMNS)


@register("category_assign", "with " + category_ctes("products") + """
select product_id, cast(primary_category_idx as int) as primary_category_idx, primary_category,
  cast(secondary_category_idx as int) as secondary_category_idx, secondary_category
from cat_final
""")
def category_assign(spark, sf):
    return with_category_features(products(spark, sf)).select(
        "product_id", "primary_category_idx", "primary_category",
        "secondary_category_idx", "secondary_category")


# ------------------------------------------------------------------ J1–J7, J9, J10
from pyspark.sql import functions as F  # noqa: E402

from nameprice.functions import features as FT  # noqa: E402
from nameprice.operators import correlation, scale  # noqa: E402
from nameprice.plans import sql_features as SF  # noqa: E402


def _family(name: str, builder, columns: list[str], sql: str, spec: list | None, doc: str):
    dbl = SF.double_columns(spec) if spec is not None else None

    @register(name, sql, dbl)
    def q(spark, sf):
        return builder(products(spark, sf).select("product_id", "name")).select(
            "product_id", *columns)

    q.__doc__ = doc
    return q


_BASIC5_SPEC = [("max_number", "", "double"), ("min_number", "", "double"),
                ("sum_numbers", "", "double"), ("avg_number", "", "double")]
_family("features_basic5", FT.with_basic5, FT.BASIC5_COLUMNS, SF.basic5_sql(), _BASIC5_SPEC,
        "J1: count/max/min/sum/avg of integer runs.")
_family("features_basic11", FT.with_basic11, FT.BASIC11_COLUMNS, SF.basic11_sql(),
        [("max_num", "", "double"), ("sum_num", "", "double")],
        "J2: the eleven improved-script features.")
_family("features_basic31", FT.with_basic31, FT.BASIC31_COLUMNS, SF.basic31_sql(),
        [(c, "", "double") for c in ("max_num", "min_num", "sum_num", "mean_num", "first_num")],
        "J3: the 31 grid-search features.")
_family("features_chars", FT.with_char_features, FT.CHAR_COLUMNS, SF.chars_sql(),
        SF.char_spec(), "J4: 30 character-class features.")
_family("features_numbers", FT.with_number_features, FT.NUMBER_COLUMNS, SF.numbers_sql(),
        SF.number_spec(), "J5: 21 number statistics.")
_family("features_units", FT.with_unit_features, FT.UNIT_COLUMNS, SF.units_sql(),
        [(c, "", "double") for c in FT.UNIT_COLUMNS if not c.endswith("_flag")],
        "J6: unit family counts and converted dimension/weight/volume stats.")
_family("features_tokens", FT.with_token_features, FT.TOKEN_COLUMNS, SF.tokens_sql(True),
        SF.token_spec(True), "J7: token structure, token hashes, keyword flags.")
_family("features_signals", FT.with_signal_features, FT.SIGNAL_COLUMNS, SF.signals_sql(),
        SF.signal_spec(), "J9: colour/gender/age/season/festival and flag signals.")


def _all_features_sql() -> str:
    parts = [SF.chars_sql(), SF.numbers_sql(), SF.units_sql(), SF.tokens_sql(True),
             "with " + category_ctes("products") + " select s.product_id, "
             + category_feature_select() + " from cat_scores s join cat_final f using (product_id)",
             SF.signals_sql()]
    body = "select * from (" + parts[0] + ") f0"
    for i, p in enumerate(parts[1:], 1):
        body += f" join ({p}) f{i} using (product_id)"
    return body


_ALL_DOUBLES = (SF.double_columns(SF.char_spec()) + SF.double_columns(SF.number_spec())
                + [c for c in FT.UNIT_COLUMNS if not c.endswith("_flag")]
                + SF.double_columns(SF.token_spec(True)) + CATEGORY_DOUBLE_COLS
                + SF.double_columns(SF.signal_spec()))


@register("features_all", _all_features_sql(), _ALL_DOUBLES)
def features_all(spark, sf):
    """J10 + D1: the 201-column feature frame (198 numeric, 3 string), nulls → 0."""
    return FT.with_all_features(products(spark, sf).select("product_id", "name")).drop("name")


@register("feature_sample", "select * from (" + _all_features_sql()
          + ") s order by product_id limit 200", _ALL_DOUBLES)
def feature_sample(spark, sf):
    """G7 + A4: the first 200 feature rows by product id (the sample sink)."""
    # features keep every row, so the first rows are the same before them; checkpointed, as the
    # planner moves projections below the limit
    first = checkpoint(products(spark, sf).select("product_id", "name").orderBy("product_id").limit(200))
    return FT.with_all_features(first).drop("name").orderBy("product_id")


@register("standardize_features", """
with f as (""" + SF.basic31_sql() + """)
select product_id, """ + ",\n  ".join(
    f"case when stddev_pop(cast({c} as double)) over () > 0 then (cast({c} as double) - "
    f"avg(cast({c} as double)) over ()) / stddev_pop(cast({c} as double)) over () else 0.0 end as {c}"
    for c in FT.BASIC31_COLUMNS) + " from f", FT.BASIC31_COLUMNS)
def standardize_features(spark, sf):
    """K5: population z-scores of the 31 features (constant columns → 0)."""
    feats = FT.with_basic31(products(spark, sf).select("product_id", "name"))
    return scale.standardize(feats, FT.BASIC31_COLUMNS, keep=["product_id"])


NUMERIC_FEATURES = [c for c in FT.all_feature_columns() if c not in FT.STRING_FEATURES]


@register("standardize_all_features", "select product_id, " + ",\n  ".join(
    f"case when stddev_pop({c}) over () > 1e-9 then ({c} - avg({c}) over ()) "
    f"/ stddev_pop({c}) over () else 0.0 end as {c}" for c in NUMERIC_FEATURES)
    + " from (select product_id, " + ", ".join(f"cast({c} as double) as {c}" for c in NUMERIC_FEATURES)
    + " from (" + _all_features_sql() + ") a) f", {c: 4 for c in NUMERIC_FEATURES})
def standardize_all_features(spark, sf):
    """K5: population z-scores of all 198 numeric features (constant columns → 0), the
    dense part of the feature-rich frame."""
    feats = FT.with_all_features(products(spark, sf).select("product_id", "name"))
    return scale.standardize(feats, NUMERIC_FEATURES, keep=["product_id"])


def _corr_sql() -> str:
    numeric = [c for c in FT.all_feature_columns() if c not in FT.STRING_FEATURES]
    casts = ", ".join(f"cast({c} as double) as {c}" for c in numeric)
    return f"""
with f as (select p.price, {casts} from ({_all_features_sql()}) a join products p using (product_id)),
u as (unpivot f on {", ".join(numeric)} into name feature value x)
select feature, covar_pop(x, cast(price as double))
    / nullif(stddev_pop(x) * stddev_pop(cast(price as double)), 0) as correlation
from u group by feature
"""


@register("feature_price_correlation", _corr_sql(), ["correlation"])
def feature_price_correlation(spark, sf):
    """E6 + G2: Pearson correlation of every numeric feature with price, by |r| desc
    (NULL for constant features)."""
    feats = FT.with_all_features(products(spark, sf))
    numeric = [c for c in FT.all_feature_columns() if c not in FT.STRING_FEATURES]
    return correlation.correlations_with(feats, numeric, "price")
