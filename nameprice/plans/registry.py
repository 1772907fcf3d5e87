"""Query registry: name → (Spark query, optional DuckDB oracle SQL).

Each query takes (spark, sf_dir) and returns a lazy DataFrame over the driver
tables (or fixtures Spark derives from them). Oracles are SQL written
separately against the same parquet tables; fixture views are inlined as CTEs.
Doubles are rounded to 6 places on both sides so the engines compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nameprice.sources.fixture_sql import with_fixtures

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None,
             round_cols: list[str] | dict[str, int] | None = None, digits: int = 6):
    """Register a query.

    `round_cols` lists the double columns rounded in the oracle (to `digits`),
    or maps column → digits for large-magnitude values whose last digits depend
    on the engines' summation order.
    """
    per_col = dict(round_cols) if isinstance(round_cols, dict) else {}

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir), digits, per_col)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_fixtures(round_sql(oracle, round_cols or [], digits))
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6, per_col: dict[str, int] | None = None) -> DataFrame:
    per_col = per_col or {}
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            d = per_col.get(f.name, digits)
            cols.append(F.round(F.col(f"`{f.name}`"), d).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def round_sql(body: str, cols: list[str] | dict[str, int], digits: int = 6) -> str:
    if not cols:
        return body
    spec = cols if isinstance(cols, dict) else {c: digits for c in cols}
    repl = ", ".join(f'round("{c}", {d}) as "{c}"' for c, d in spec.items())
    return f"select * replace ({repl}) from ({body}) as r"


def load_all() -> None:
    """Import the query modules (they register on import)."""
    from nameprice.plans import (  # noqa: F401
        q_features, q_metrics, q_models, q_profile, q_stream, q_text, q_vectorize)
