"""Normaliser queries: raw JSON records built from the driver tables -> canonical rows."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from feedlake.operators import normalise as N
from feedlake.plans.registry import ORACLE, query
from feedlake.plans.sql import FEED_C_TS
from feedlake.sources.tables import raw_feed_a, raw_feed_b, raw_feed_c

_OUT = ["source", "external_id", "title", "company", "location", "url", "tags", "salary_min", "salary_max",
        "visa_sponsorship", "four_day_week", "remote", "posted_at"]


def _served(df):
    return df.select(*[F.array_join("tags", "|").alias("tags") if c == "tags" else F.col(c) for c in _OUT])


@query("normalise_a", """
select 'feed_a' as source, cast(event_id as varchar) as external_id, event_type as title,
  case when event_id % 13 = 0 then '' else 'company_' || cast(user_id as varchar) end as company,
  case when event_id % 7 = 1 then 'Remote EU' else 'Worldwide / Remote' end as location,
  case event_id % 3
    when 0 then 'https://remoteok.com/remote-jobs/' || event_type || '-' || cast(event_id as varchar)
    when 1 then 'https://remoteok.com/jobs/' || cast(event_id as varchar)
    else 'https://apply.example/' || cast(event_id as varchar) end as url,
  case when event_id % 6 = 0 then '' else event_type || '|u' || cast(user_id as varchar) end as tags,
  case when event_id % 5 in (1, 2) then cast(floor(value * 1000) as bigint)
       when event_id % 5 = 3 then cast(trunc(value * 1000) as bigint) end as salary_min,
  cast(floor(value * 1500) as bigint) as salary_max,
  cast(null as boolean) as visa_sponsorship, cast(null as boolean) as four_day_week, true as remote,
  case when event_id % 4 = 2 then null else date_trunc('second', ts) end as posted_at
from events where event_id % 97 <> 0""")
def normalise_a(spark, d):
    """NRM-A, FLT-1, F-1a, F-2a, F-4: flat-array feed records -> canonical."""
    return _served(N.normalise_flat(raw_feed_a(spark, d), source="feed_a"))


@query("normalise_b", """
select 'feed_b' as source, cast(o_orderkey as varchar) as external_id, c_mktsegment as title,
  case when o_orderkey % 11 = 0 then '' else c_name end as company,
  case o_orderkey % 4 when 0 then n_name || ', ' || r_name when 1 then n_name || ', ' || r_name
    when 2 then 'Worldwide / Remote' else r_name end as location,
  'https://feed-b.example/' || cast(o_orderkey as varchar) as url,
  lower(o_orderpriority) || '|' || lower(c_mktsegment) || '|' || lower(o_orderstatus) as tags,
  case when o_orderstatus = 'P' then null else cast(floor(o_totalprice) as bigint) end as salary_min,
  case when o_orderkey % 2 = 0 then null else cast(floor(o_totalprice * 1.2) as bigint) end as salary_max,
  cast(null as boolean) as visa_sponsorship, cast(null as boolean) as four_day_week,
  o_orderpriority in ('1-URGENT', '2-HIGH') as remote,
  case when o_orderkey % 3 = 2 then null else o_orderdate + interval 8217 days end as posted_at
from orders join customer on c_custkey = o_custkey
  join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey
where o_orderkey % 101 <> 0""")
def normalise_b(spark, d):
    """NRM-B, F-1b, F-2b, F-5, F-6, F-7: cursor feed records -> canonical."""
    return _served(N.normalise_cursor(raw_feed_b(spark, d), source="feed_b"))


@query("normalise_c", f"""
select 'feed_c' as source, source || '-' || cast(doc_id as varchar) as external_id,
  'doc ' || cast(doc_id as varchar) as title, source as company,
  case when doc_id % 2 = 0 then lang else '' end as location,
  'https://feed-c.example/' || cast(doc_id as varchar) as url, lang as tags,
  cast(null as bigint) as salary_min, cast(null as bigint) as salary_max,
  lang = 'de' as visa_sponsorship,
  case when doc_id % 3 = 0 then false else n_chars % 2 = 0 end as four_day_week,
  case doc_id % 5 when 0 then true when 1 then false else n_chars % 3 = 0 end as remote,
  {FEED_C_TS} as posted_at
from documents where doc_id % 50 <> 7""")
def normalise_c(spark, d):
    """NRM-C: page feed records -> canonical (truthiness booleans, epoch created_at)."""
    return _served(N.normalise_paged(raw_feed_c(spark, d), source="feed_c"))


@query("parse_skip_counts", """
select 'feed_a' as source, count(*) as received, count(*) filter (where event_id % 97 <> 0) as parsed,
  count(*) filter (where event_id % 97 = 0) as skipped from events
union all
select 'feed_b', count(*), count(*) filter (where o_orderkey % 101 <> 0), count(*) filter (where o_orderkey % 101 = 0)
from orders join customer on c_custkey = o_custkey
union all
select 'feed_c', count(*), count(*) filter (where doc_id % 50 <> 7), count(*) filter (where doc_id % 50 = 7)
from documents""")
def parse_skip_counts(spark, d):
    """AGG-5: received / parsed / skipped records per feed."""
    parts = []
    for src, raw, fn in (("feed_a", raw_feed_a, N.normalise_flat), ("feed_b", raw_feed_b, N.normalise_cursor),
                         ("feed_c", raw_feed_c, N.normalise_paged)):
        r = raw(spark, d).withColumn("source", F.lit(src))
        parts.append(N.parse_counts(r, fn(r, source=src, keep=[]), ["source"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("parse_observed_counts", ORACLE["parse_skip_counts"])
def parse_observed_counts(spark, d):
    """AGG-5/STR-8: the same counts, taken by observation in the pass that writes each feed's normalised records."""
    rows = []
    for src, raw in (("feed_a", raw_feed_a), ("feed_b", raw_feed_b), ("feed_c", raw_feed_c)):
        seen = Observation()
        N.counted(raw(spark, d), N.REGISTRY[src], seen).write.format("noop").mode("overwrite").save()
        rows.append((src, seen.get["received"], seen.get["parsed"], seen.get["skipped"]))
    return spark.createDataFrame(rows, "source string, received long, parsed long, skipped long")


_KEYS_A = ["id", "position", "company", "url", "slug", "apply_url", "epoch", "date", "location", "tags",
           "salary_min", "salary_max"]
_KEYS_C = ["slug", "title", "company_name", "url", "location", "tags", "visa_sponsorship", "four_day_week",
           "remote", "created_at"]


def _values(rows):
    return ", ".join(f"('{a}', '{b}', '{k}')" for a, b, k in rows)


_DIFF = ([("feed_a", "feed_c", k) for k in _KEYS_A if k not in _KEYS_C]
         + [("feed_c", "feed_a", k) for k in _KEYS_C if k not in _KEYS_A])


@query("key_set_diff", f"select * from (values {_values(_DIFF)}) t(source, other_source, key)")
def key_set_diff(spark, d):
    """SET-3: raw keys seen in one feed but in no record of the other (both directions)."""
    a = raw_feed_a(spark, d).select(F.explode(F.json_object_keys("raw")).alias("key")).distinct()
    c = raw_feed_c(spark, d).select(F.explode(F.json_object_keys("raw")).alias("key")).distinct()
    ac = a.join(c, "key", "left_anti").select(F.lit("feed_a").alias("source"), F.lit("feed_c").alias("other_source"), "key")
    ca = c.join(a, "key", "left_anti").select(F.lit("feed_c").alias("source"), F.lit("feed_a").alias("other_source"), "key")
    return ac.unionByName(ca)
