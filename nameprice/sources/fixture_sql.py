"""DuckDB text of the fixture views, inlined as CTEs ahead of every oracle.

Written independently of the DataFrame builders in `tables.py`; the driver
registers only the base tables, so each oracle carries these definitions.
`||` is used wherever an input can be null (DuckDB `concat` skips nulls).
"""

PRODUCTS = """
select p_partkey as product_id,
  case when p_partkey % 97 = 0 then null else concat(
    case cast(p_partkey % 8 as int)
      when 0 then '【日本進口】' when 1 then '#A-12 ' when 2 then 'SALE 特價 '
      when 3 then '' when 4 then '限量 ' when 5 then '冬 '
      when 6 then 'USB 充電 ' else '3/4 ' end,
    p_name, ' ', p_brand, ' ', p_type, ' ',
    case cast(p_partkey % 6 as int)
      when 0 then concat(cast(p_size as varchar), 'cm 收納櫃')
      when 1 then concat(cast(p_size * 10 as varchar), 'ML 保濕面膜 5入')
      when 2 then concat(cast(p_size as varchar), '.5kg 米')
      when 3 then concat('x', cast(p_size as varchar), ' 公分 女外套 紅')
      when 4 then '50% 嬰兒奶瓶 250毫升'
      else '黃金手錶 !?' end) end as name,
  cast(case when p_partkey % 50 = 0 then 0
    else (((p_size * (case cast(p_partkey % 6 as int) when 0 then 11 when 1 then 3 when 2 then 40
        when 3 then 25 when 4 then 8 else 300 end) + 50) * (10 + p_partkey % 8)
        * (90 + (p_partkey * 7919) % 21)) // 1000)
      * (case when p_partkey % 41 = 0 then 100 else 1 end) end as bigint) as price
from part
"""

PRODUCTS_UNPRICED = """
select -p_partkey - 1 as product_id,
  concat(case cast((p_partkey + 3) % 8 as int)
      when 0 then '【日本進口】' when 1 then '#A-12 ' when 2 then 'SALE 特價 '
      when 3 then '' when 4 then '限量 ' when 5 then '冬 '
      when 6 then 'USB 充電 ' else '3/4 ' end,
    p_name, ' ', p_brand, ' ', p_type, ' ',
    case cast((p_partkey + 1) % 6 as int)
      when 0 then concat(cast(p_size as varchar), 'cm 收納櫃')
      when 1 then concat(cast(p_size * 10 as varchar), 'ML 保濕面膜 5入')
      when 2 then concat(cast(p_size as varchar), '.5kg 米')
      when 3 then concat('x', cast(p_size as varchar), ' 公分 女外套 紅')
      when 4 then '50% 嬰兒奶瓶 250毫升'
      else '黃金手錶 !?' end) as name
from part
"""

PRODUCTS_LARGE = """
select ((l.l_orderkey * 8 + l.l_linenumber) * 1000000 + l.l_partkey) * 100000 + l.l_suppkey
    as product_id,
  p.name || ' ' || cast(cast(l.l_quantity as int) as varchar) || '入' as name,
  cast(floor(l.l_extendedprice) as bigint) as price
from lineitem l join products p on l.l_partkey = p.product_id
"""

PREDICTIONS = """
select product_id, model, price as y,
  case when model = 'failed' or product_id % 53 = 0 then null
    when (product_id + k) % 59 = 0 then cast('nan' as double)
    when product_id % 29 = 0 then cast(-5 as double)
    else cast(price as double)
      * (cast(1 as double) + cast((product_id * k) % 41 - 20 as double) / cast(100 as double))
    end as yhat
from (
  select product_id, price, 'ridge' as model, 37 as k from products
  union all select product_id, price, 'tree_a', 13 from products
  union all select product_id, price, 'tree_b', 7 from products
  union all select product_id, price, 'failed', 0 from products) pm
"""

EXPERIMENT_LOG = """
select p_partkey as run_id, 'v1_notok' as preprocessing, 'tfidf_5k_12' as vectorization,
  'GB_' || cast(p_partkey % 36 as varchar) as model, true as use_log,
  cast(20 + (p_partkey % 36) * 37 % 23 as varchar) as val_smape,
  cast(10 + p_partkey as varchar) as train_time,
  'v1_notok|tfidf_5k_12|GB_' || cast(p_partkey % 36 as varchar) || '_log' as full_name
from part
"""

PREFIX = ("with products as (" + PRODUCTS + "), products_unpriced as (" + PRODUCTS_UNPRICED
          + "), products_large as (" + PRODUCTS_LARGE
          + "), predictions as (" + PREDICTIONS + "), experiment_log as ("
          + EXPERIMENT_LOG + ") ")


def with_fixtures(body: str) -> str:
    """Wrap an oracle query so it can use the fixture views by name."""
    return PREFIX + "select * from (" + body + ") as oracle_result"
