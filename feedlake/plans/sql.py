"""Shared SQL fragments for the oracle texts (DuckDB dialect over the driver views)."""

# {TS} of feed C in DuckDB: epoch seconds -> naive UTC timestamp.
FEED_C_TS = "make_timestamp((1704067200 + (doc_id % 1000) * 2590) * 1000000)"

FEED_A = """
select 'feed_a' as source, cast(event_id as varchar) as external_id, event_type as title,
  concat('company_', cast(user_id as varchar)) as company, 'Worldwide / Remote' as location,
  concat('https://feed-a.example/jobs/', event_type, '-', cast(event_id as varchar)) as url,
  cast(floor(value * 1000) as bigint) as salary_min, cast(floor(value * 1500) as bigint) as salary_max,
  cast(null as boolean) as visa_sponsorship, true as remote, ts as posted_at
from events"""

FEED_B = """
select 'feed_b' as source, cast(o_orderkey as varchar) as external_id, c_mktsegment as title,
  c_name as company, concat_ws(', ', n_name, r_name) as location,
  concat('https://feed-b.example/', cast(o_orderkey as varchar)) as url,
  case when o_orderstatus = 'P' then null else cast(floor(o_totalprice) as bigint) end as salary_min,
  cast(null as bigint) as salary_max, cast(null as boolean) as visa_sponsorship,
  o_orderpriority = '1-URGENT' as remote, o_orderdate + interval 8217 days as posted_at
from orders join customer on c_custkey = o_custkey
  join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey"""

FEED_C = f"""
select 'feed_c' as source, concat(source, '-', cast(doc_id as varchar)) as external_id,
  concat('doc ', cast(doc_id as varchar)) as title, source as company, '' as location,
  concat('https://feed-c.example/', cast(doc_id as varchar)) as url,
  cast(null as bigint) as salary_min, cast(null as bigint) as salary_max,
  lang = 'de' as visa_sponsorship, n_chars % 2 = 0 as remote, {FEED_C_TS} as posted_at
from documents"""

LISTINGS_CTE = f"""
with feed_a as ({FEED_A}), feed_b as ({FEED_B}), feed_c as ({FEED_C}),
listings as (select * from feed_a union all select * from feed_b union all select * from feed_c)
"""

NEWEST_FIRST = "posted_at desc nulls last, source, external_id"
