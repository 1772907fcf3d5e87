"""DuckDB SQL fragments for the oracles, generated from the fixed lexicon.

These are oracle-side only: the Spark code builds its Columns directly.
RE2 (DuckDB) and Java both accept `\\Q…\\E` literal quoting.
"""

from __future__ import annotations

from nameprice.functions.lexicon import CATEGORY_KEYWORDS, CATEGORY_NAMES, java_alternation


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re_count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {sql_str(pattern)}))"


def category_ctes(source: str = "products") -> str:
    """CTEs cat_scores (product_id + 23 scores) and cat_agg (derived per product)."""
    scores = ",\n  ".join(
        f"cast({re_count('t', java_alternation(terms))} as double) as {cat}"
        for cat, terms in CATEGORY_KEYWORDS.items())
    ords = ", ".join(f"({sql_str(c)}, {i})" for i, c in enumerate(CATEGORY_NAMES))
    cols = ", ".join(CATEGORY_NAMES)
    return f"""
cat_scores as (
  select product_id,
  {scores}
  from (select product_id, lower(coalesce(name, '')) as t from {source}) b),
cat_long as (
  select u.product_id, u.label, o.ord, u.score
  from (unpivot cat_scores on {cols} into name label value score) u
  join (values {ords}) o(label, ord) on u.label = o.label),
cat_ranked as (
  select *, row_number() over (partition by product_id order by score desc, ord) as rn,
    sum(score) over (partition by product_id) as tot
  from cat_long),
cat_agg as (
  select product_id,
    cast(sum(case when score > 0 then 1 else 0 end) as double) as hits,
    sum(score) as tot,
    -sum((case when tot > 0 then score / tot else 0 end)
         * ln((case when tot > 0 then score / tot else 0 end) + 1e-12)) as entropy,
    max(case when rn = 1 then ord end) as p1_ord, max(case when rn = 1 then label end) as p1_label,
    max(case when rn = 1 then score end) as p1_score,
    max(case when rn = 2 then ord end) as p2_ord, max(case when rn = 2 then label end) as p2_label,
    max(case when rn = 2 then score end) as p2_score
  from cat_ranked group by product_id),
cat_final as (
  select product_id, hits, tot, entropy,
    case when tot = 0 then 23 else p1_ord end as primary_category_idx,
    case when tot = 0 then 'other' else p1_label end as primary_category,
    case when tot = 0 then 0.0 else p1_score end as primary_category_score,
    case when tot = 0 then 23 else p2_ord end as secondary_category_idx,
    case when tot = 0 then 'other' else p2_label end as secondary_category,
    case when tot = 0 then 0.0 else p2_score end as secondary_category_score
  from cat_agg)
"""


def category_feature_select() -> str:
    """Select list over cat_scores s join cat_final f (60 columns)."""
    flags = ", ".join(f"cast(s.{c} > 0 as int) as cat_flag_{c}" for c in CATEGORY_NAMES)
    scores = ", ".join(f"s.{c}" for c in CATEGORY_NAMES)
    return f"""{scores}, {flags},
  f.hits as category_hit_count, f.tot as category_score_sum, f.entropy as category_entropy,
  cast(f.primary_category_idx as int) as primary_category_idx, f.primary_category,
  cast(f.primary_category_score as double) as primary_category_score,
  cast(f.secondary_category_idx as int) as secondary_category_idx, f.secondary_category,
  cast(f.secondary_category_score as double) as secondary_category_score,
  case when f.tot > 0 then f.primary_category_score / (f.tot + 1e-6) else 0.0 end as category_score_ratio,
  cast(f.primary_category_score - f.secondary_category_score as double) as category_gap,
  case when f.primary_category_score > 0 then (f.primary_category_score - f.secondary_category_score)
    / (f.primary_category_score + 1e-6) else 0.0 end as category_confidence,
  cast(f.hits >= 2 as int) as category_has_multiple,
  f.hits / 23.0 as category_hit_ratio"""


CATEGORY_DOUBLE_COLS = list(CATEGORY_NAMES) + [
    "category_hit_count", "category_score_sum", "category_entropy",
    "primary_category_score", "secondary_category_score", "category_score_ratio",
    "category_gap", "category_confidence", "category_hit_ratio"]
