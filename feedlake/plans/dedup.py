"""Two-key de-duplication queries (DED-3, AGG-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions import rules as R
from feedlake.operators import dedup as D
from feedlake.operators import serving as S
from feedlake.plans.registry import query
from feedlake.plans.sql import LISTINGS_CTE
from feedlake.sources.tables import listings, table

_ORDERS_KEYS = """
select o_orderkey, o_orderpriority || ':::' || strftime(o_orderdate, '%Y-%m') as pair,
  cast(o_custkey % 300 as varchar) as url from orders"""

# Oracle: the sequential definition itself, as a recursive walk carrying the
# keys registered by kept rows.
_WALK = f"""
with recursive base as (
  select row_number() over (order by o_orderkey) as i, * from ({_ORDERS_KEYS})),
walk(i, seen_p, seen_u, kept) as (
  select 0::bigint, []::varchar[], []::varchar[], null::bigint
  union all
  select b.i,
    case when k then list_append(w.seen_p, b.pair) else w.seen_p end,
    case when k then list_append(w.seen_u, b.url) else w.seen_u end,
    case when k then b.o_orderkey end
  from walk w join (select *, true as t from base) b on b.i = w.i + 1,
  lateral (select not list_contains(w.seen_p, b.pair) and not list_contains(w.seen_u, b.url) as k))
select o_orderkey, pair, url from walk join base on base.o_orderkey = walk.kept"""


@query("dedup_two_key", _WALK)
def dedup_two_key(spark, d):
    """DED-3: greedy pair/url dedup of all orders in key order (pair = priority:::month,
    url = customer key mod 300)."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_custkey")
    o = o.select("o_orderkey",
                 F.concat("o_orderpriority", F.lit(":::"), F.date_format("o_orderdate", "yyyy-MM")).alias("pair"),
                 (F.col("o_custkey") % 300).cast("string").alias("url"))
    return D.greedy_two_key(o, F.col("o_orderkey"), F.col("pair"), F.col("url"))


def _dedup_listings(spark, d):
    df = S.displayable(listings(spark, d))
    return D.greedy_two_key(df, D.newest_first_order(), R.pair_key(F.col("company"), F.col("title")),
                            R.dedup_key(F.col("url")))


# Every derived listing has its own url, so the rule reduces to "first row per
# pair in newest-first order" on this input.
@query("dedup_source_counts", LISTINGS_CTE + """
select source, count(*) as n from (
  select source from listings
  where length(title) > 0 and length(company) > 0 and length(url) > 0
  qualify row_number() over (partition by lower(trim(company)) || ':::' || lower(trim(title))
                             order by posted_at desc nulls last, source, external_id) = 1)
group by source""")
def dedup_source_counts(spark, d):
    """AGG-4: listings per source after the two-key dedup of the served list."""
    return _dedup_listings(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
