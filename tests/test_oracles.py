"""Registered queries vs their DuckDB oracle SQL (a representative subset, sf0.001)."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from nameprice.sources.tables import DRIVER_TABLES

SUBSET = ["category_price_summary", "features_all", "features_categories", "price_describe",
          "split_stratified", "tfidf_weights", "char_tfidf_vocab", "blend_grid", "model_comparison",
          "leaderboard_topk", "clean_keep_symbols", "tokenize_mixed", "stream_leaderboard",
          "feature_price_correlation", "price_quantile_bins", "validate_predictions"]


def _norm(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return "NULL" if v is None else str(int(v) if isinstance(v, bool) else v)


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    res = con.sql(entry.oracle_sql()[name])
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(res.columns)
    assert _canon(df.columns, srows) == _canon(res.columns, orows)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "median" in df.columns
