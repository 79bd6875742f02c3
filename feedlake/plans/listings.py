"""Serving queries over the stored listings (derived feeds A, B, C)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedlake.operators import normalise as N
from feedlake.operators import serving as S
from feedlake.plans.registry import query
from feedlake.plans.sql import LISTINGS_CTE, NEWEST_FIRST
from feedlake.session import ensure_checkpoint_dir
from feedlake.sources.tables import listings

# Fixed "now" for every time-relative view, so results are reproducible.
AS_OF = "2024-02-01 00:00:00"


def as_of_col():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query("listings_latest", LISTINGS_CTE + f"select * from listings order by {NEWEST_FIRST} limit 1000")
def listings_latest(spark, d):
    """SRC-5/SRT-1/NRM-F: newest 1000 listings across all feeds (the served maximum)."""
    return S.latest(listings(spark, d), limit=1000)


@query("listings_by_source",
       LISTINGS_CTE + f"select * from listings where source = 'feed_b' order by {NEWEST_FIRST} limit 200")
def listings_by_source(spark, d):
    """FLT-2 + SRT-1: one source, newest first, default limit 200."""
    return S.latest(listings(spark, d), source="feed_b", limit=200)


@query("listings_remote", LISTINGS_CTE + "select * from listings where remote = true")
def listings_remote(spark, d):
    """FLT-3: remote listings (all of them)."""
    return S.remote_only(listings(spark, d))


@query("listings_with_salary", LISTINGS_CTE + "select * from listings where salary_min is not null")
def listings_with_salary(spark, d):
    """FLT-4: listings with a compensation lower bound (0 passes)."""
    return S.with_salary(listings(spark, d))


@query("listings_visa", LISTINGS_CTE + "select * from listings where visa_sponsorship = true")
def listings_visa(spark, d):
    """FLT-5: listings offering visa sponsorship."""
    return S.visa(listings(spark, d))


@query("unified_listings", LISTINGS_CTE + "select * from listings")
def unified_listings(spark, d):
    """SET-1/NRM-E: bag union of the three feeds, each held to the canonical fields that it serves."""
    from feedlake.sources.tables import listings_feed_a, listings_feed_b, listings_feed_c

    frames = [feed(spark, d) for feed in (listings_feed_a, listings_feed_b, listings_feed_c)]
    return N.unify(*frames, fields=frames[0].columns)


_FILTERS = ["all", "feed_a", "feed_b", "remote", "salary"]


@query("page_summary", LISTINGS_CTE + """
select f as filter, cast(n as bigint) as total_items, cast(greatest(1, ceil(n / 8.0)) as bigint) as total_pages
from (
  select 'all' as f, count(*) as n from listings
  union all select 'feed_a', count(*) filter (where source = 'feed_a') from listings
  union all select 'feed_b', count(*) filter (where source = 'feed_b') from listings
  union all select 'remote', count(*) filter (where remote = true) from listings
  union all select 'salary', count(*) filter (where salary_min is not null) from listings)""")
def page_summary(spark, d):
    """AGG-8: totals and page counts per filter chip, one pass over the listings."""
    return S.page_summary(listings(spark, d), _FILTERS)


PAGE = 3


@query("page_slice", LISTINGS_CTE + f"""
select *, cast({PAGE} as bigint) as page from listings where remote = true
order by {NEWEST_FIRST} limit 8 offset {(PAGE - 1) * 8}""")
def page_slice(spark, d):
    """WIN-1: page 3 (8 per page) of the remote filter, newest first."""
    df = S.remote_only(listings(spark, d))
    total = df.count()
    return S.page_slice(df, PAGE, total)


@query("page_deep", LISTINGS_CTE + f"""
select * exclude (i, n), cast(ceil(n / 16.0) as bigint) as page
from (select *, row_number() over (order by {NEWEST_FIRST}) - 1 as i, count(*) over () as n from listings where remote = true)
where i >= (ceil(n / 16.0) - 1) * 8 and i < ceil(n / 16.0) * 8""")
def page_deep(spark, d):
    """WIN-1: the middle page of the remote filter, read from the two or three ranges of the stored order that hold it."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pages/{uuid.uuid4().hex}"
    S.store_ranked(S.remote_only(listings(spark, d)), path, 64)
    total = spark.read.parquet(f"{path}/index").agg(F.sum("n")).first()[0]
    return S.stored_page(spark, path, -(-total // 16))


_CARD_SQL = """
select source, external_id,
  case when source = 'feed_a' then 'Feed A' else 'Feed B' end as source_label,
  company, title,
  case when length(location) > 0 then location else 'Worldwide / Remote' end as location_label,
  coalesce(remote, false) as remote_pill,
  case when coalesce(salary_min, 0) <> 0 and coalesce(salary_max, 0) <> 0
         then concat('$', cast(floor(salary_min / 1000.0 + 0.5) as bigint), 'k–$', cast(floor(salary_max / 1000.0 + 0.5) as bigint), 'k')
       when coalesce(salary_min, 0) <> 0 then concat('From $', cast(floor(salary_min / 1000.0 + 0.5) as bigint), 'k')
       when coalesce(salary_max, 0) <> 0 then concat('Up to $', cast(floor(salary_max / 1000.0 + 0.5) as bigint), 'k')
  end as salary_text,
  {rel} as posted_label,
  array_to_string(list_transform(range(1, least(length(external_id), 5) + 1), lambda i: '#t' || substring(external_id, i, 1)), ' ') as tag_text,
  substring(external_id, 1, 20) as id_text,
  case when length(url) > 0 then url else concat('https://feed-a.example/jobs/', external_id) end as apply_url,
  case when source = 'feed_a' then 'View on Feed A' else concat('Apply at ', company) end as apply_label
from listings"""

# Relative time against the fixed as-of instant, in SQL.
_REL_SQL = """case
  when floor(ms / 60000.0) <= 0 then 'Just now'
  when floor(ms / 60000.0) < 60 then concat(cast(floor(ms / 60000.0) as bigint), 'm ago')
  when floor(ms / 3600000.0) < 24 then concat(cast(floor(ms / 3600000.0) as bigint), 'h ago')
  when floor(ms / 86400000.0) = 1 then '1d ago'
  when floor(ms / 86400000.0) < 7 then concat(cast(floor(ms / 86400000.0) as bigint), 'd ago')
  when floor(ms / 86400000.0) <= 14 then concat(cast(floor(floor(ms / 86400000.0) / 7) as bigint), 'w ago')
  else 'Active' end"""

_MS = (f"date_diff('millisecond', coalesce(case when external_id not like '%7' then posted_at end, "
       f"timestamp '{AS_OF}' - length(external_id) * interval 1 hour), timestamp '{AS_OF}')")

_CARDS_ORACLE = LISTINGS_CTE.replace(
    "listings as (", f"listings0 as (").rstrip() + f""",
listings as (select *, {_MS} as ms from listings0)
""" + _CARD_SQL.format(rel=_REL_SQL)


def _card_rows(spark, d):
    """The listings with a tag per character of the id, without a date where the id ends
    in 7, and ingested as many hours before the as-of time as the id is long."""
    n = F.length("external_id")
    return listings(spark, d).select(
        "*", F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("t"), F.substr("external_id", i, F.lit(1)))).alias("tags"),
        F.timestamp_add("HOUR", -n, as_of_col()).alias("ingested_at")).withColumn(
        "posted_at", F.when(~F.col("external_id").endswith("7"), F.col("posted_at")))


@query("listing_cards", _CARDS_ORACLE)
def listing_cards(spark, d):
    """NRM-G/F-8/F-9/F-11: display cards for every listing at a fixed as-of time."""
    return S.cards(_card_rows(spark, d), as_of_col())


@query("relative_time", _CARDS_ORACLE.replace(_CARD_SQL.format(rel=_REL_SQL), "") + f"""
select source, {_REL_SQL} as posted_label, count(*) as n from listings group by all""")
def relative_time(spark, d):
    """F-8: listings per source and relative-time label."""
    c = S.cards(_card_rows(spark, d), as_of_col())
    return c.groupBy("source", "posted_label").agg(F.count(F.lit(1)).alias("n"))


@query("salary_label", _CARDS_ORACLE.replace(_CARD_SQL.format(rel=_REL_SQL), "") + """
select salary_text, count(*) as n from (
""" + _CARD_SQL.format(rel="''") + """
) group by all""")
def salary_label(spark, d):
    """F-9: listings per salary text."""
    c = S.cards(_card_rows(spark, d), as_of_col())
    return c.groupBy("salary_text").agg(F.count(F.lit(1)).alias("n"))


def _with_pos(df, pos_expr):
    return df.withColumn("_arrival", pos_expr)


@query("failover_union", LISTINGS_CTE + """
select * exclude (prio, pos) from (
  select *, 1 as prio, cast(external_id as bigint) as pos from feed_a
  union all select *, 2, cast(external_id as bigint) from feed_b)
order by prio, pos limit 200""")
def failover_union(spark, d):
    """SRC-10: direct read of feed A then feed B in arrival order, head 200."""
    from feedlake.sources.tables import listings_feed_a, listings_feed_b

    a = _with_pos(listings_feed_a(spark, d), F.col("external_id").cast("bigint"))
    b = _with_pos(listings_feed_b(spark, d), F.col("external_id").cast("bigint"))
    return S.failover_union([(1, a, "_arrival"), (2, b, "_arrival")], 200).drop("_arrival")


@query("fallback_if_empty", LISTINGS_CTE + """
select 'nobody' as requested, * from feed_c where not exists (select 1 from listings where company = 'nobody')
union all select 'nobody', * from listings where company = 'nobody'
union all select 'feed_b', * from listings where source = 'feed_b'
union all select 'feed_b', * from feed_c where not exists (select 1 from listings where source = 'feed_b')""")
def fallback_if_empty(spark, d):
    """SRC-11: a read that the data leave empty (no such company) falls back to the
    backup feed (C); a non-empty one ('feed_b') does not."""
    from feedlake.sources.tables import listings_feed_c

    reads = {"nobody": listings(spark, d).where(F.col("company") == "nobody"), "feed_b": S.by_source(listings(spark, d), "feed_b")}
    out = None
    for req, primary in reads.items():
        part = S.fallback_if_empty(primary, listings_feed_c(spark, d)).select(F.lit(req).alias("requested"), "*")
        out = part if out is None else out.unionByName(part)
    return out
