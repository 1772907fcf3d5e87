"""Keyword-category features (60 columns) and the primary/secondary category.

Scores are non-overlapping keyword counts per category over the lowercased
name. Arg-max ties keep the earliest category in lexicon order; the label is
the category's own name (the surveyed code looked labels up in a re-sorted
list, which mislabels all but one category: fixed here on purpose).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nameprice.functions.common import keyword_count, safe_text
from nameprice.functions.lexicon import (
    CATEGORY_KEYWORDS, CATEGORY_NAMES, OTHER_CATEGORY, OTHER_INDEX)

SCORE_COLUMNS = list(CATEGORY_NAMES)
FLAG_COLUMNS = [f"cat_flag_{c}" for c in CATEGORY_NAMES]
DERIVED_COLUMNS = [
    "category_hit_count", "category_score_sum", "category_entropy",
    "primary_category_idx", "primary_category", "primary_category_score",
    "secondary_category_idx", "secondary_category", "secondary_category_score",
    "category_score_ratio", "category_gap", "category_confidence",
    "category_has_multiple", "category_hit_ratio",
]
CATEGORY_COLUMNS = SCORE_COLUMNS + FLAG_COLUMNS + DERIVED_COLUMNS
STRING_COLUMNS = ["primary_category", "secondary_category"]


def category_scores(lowered: Column) -> list[Column]:
    return [keyword_count(lowered, [t.lower() for t in terms]).cast("double").alias(cat)
            for cat, terms in CATEGORY_KEYWORDS.items()]


def _summary() -> list[Column]:
    """Stage 2: total, hit count, entropy and the (score desc, ord asc) ranking."""
    scores = [F.col(c) for c in SCORE_COLUMNS]
    total = sum(scores[1:], scores[0])
    hits = sum([(s > 0).cast("int") for s in scores[1:]], (scores[0] > 0).cast("int"))
    # (−score, ord) ascending == score desc, lexicon order asc: element 0 is the
    # arg-max with the first-wins tie rule, element 1 the runner-up
    ranked = F.sort_array(F.array(*[
        F.struct((-s).alias("neg"), F.lit(i).alias("ord"), F.lit(c).alias("label"))
        for i, (c, s) in enumerate(zip(CATEGORY_NAMES, scores))]))
    return [total.alias("_total"), hits.alias("_hits"),
            F.slice(ranked, 1, 2).alias("_top2")]


def _derived() -> list[Column]:
    """Stage 3: everything else from the stage-2 columns."""
    total, hits = F.col("_total"), F.col("_hits")
    p = [F.when(total > 0, F.col(c) / total).otherwise(F.lit(0.0)) for c in SCORE_COLUMNS]
    terms = [x * F.log(x + F.lit(1e-12)) for x in p]
    entropy = -sum(terms[1:], terms[0])
    none = total == 0
    p1, p2 = F.col("_top2").getItem(0), F.col("_top2").getItem(1)
    primary_score = F.when(none, F.lit(0.0)).otherwise(-p1["neg"])
    secondary_score = F.when(none, F.lit(0.0)).otherwise(-p2["neg"])
    return [
        hits.cast("double").alias("category_hit_count"),
        total.alias("category_score_sum"),
        entropy.alias("category_entropy"),
        F.when(none, F.lit(OTHER_INDEX)).otherwise(p1["ord"]).alias("primary_category_idx"),
        F.when(none, F.lit(OTHER_CATEGORY)).otherwise(p1["label"]).alias("primary_category"),
        primary_score.alias("primary_category_score"),
        F.when(none, F.lit(OTHER_INDEX)).otherwise(p2["ord"]).alias("secondary_category_idx"),
        F.when(none, F.lit(OTHER_CATEGORY)).otherwise(p2["label"]).alias("secondary_category"),
        secondary_score.alias("secondary_category_score"),
        F.when(total > 0, primary_score / (total + F.lit(1e-6))).otherwise(F.lit(0.0))
        .alias("category_score_ratio"),
        (primary_score - secondary_score).alias("category_gap"),
        F.when(primary_score > 0, (primary_score - secondary_score) / (primary_score + F.lit(1e-6)))
        .otherwise(F.lit(0.0)).alias("category_confidence"),
        (hits >= 2).cast("int").alias("category_has_multiple"),
        (hits.cast("double") / F.lit(float(len(CATEGORY_NAMES)))).alias("category_hit_ratio"),
    ]


def with_category_features(df: DataFrame, name_col: str = "name") -> DataFrame:
    """Append the 60 category columns: three narrow projections, no shuffle.

    Staging keeps each regex count and the ranking evaluated once per row
    (CollapseProject does not inline non-trivial expressions used twice) and
    keeps every generated method under the JVM's 64 KB limit.
    """
    low = df.select("*", F.lower(safe_text(name_col)).alias("_low"))
    scored = low.select(*df.columns, *category_scores(F.col("_low")))
    summarized = scored.select("*", *_summary())
    flags = [(F.col(c) > 0).cast("int").alias(f"cat_flag_{c}") for c in SCORE_COLUMNS]
    return summarized.select(*df.columns, *SCORE_COLUMNS, *flags, *_derived())


def with_primary_category(df: DataFrame, name_col: str = "name") -> DataFrame:
    """Only the primary label (cheaper projection for grouping)."""
    return with_category_features(df, name_col).select(*df.columns, "primary_category")

