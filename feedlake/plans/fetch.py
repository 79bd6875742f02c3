"""Fetch-merge queries over ``conversations`` (conversation = fetch, turn = request)."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions import json as J
from feedlake.plans.registry import query
from feedlake.sources import fetch as FT
from feedlake.sources.tables import table


def _words():
    return F.split(F.col("text"), r"\s+")


def cursor_requests(spark, d):
    """Landed cursor-feed responses: status, job ids (words; short words carry no
    id), cursor presence; some planted errors and empty batches."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    empty = (F.col("turn") == 6) & (F.col("conv_id") % 4 == 1)
    return c.select(
        "conv_id", F.col("turn").alias("request_no"),
        F.when((F.col("conv_id") + F.col("turn")) % 9 == 8, 500).otherwise(200).alias("status"),
        F.when(empty, F.array().cast("array<string>")).otherwise(_words()).alias("jobs"),
        ((F.col("conv_id") * 3 + F.col("turn")) % 5 != 0).alias("has_cursor"))


def _cursor_merge(spark, d):
    req = cursor_requests(spark, d)
    req = FT.take_while(req, "conv_id", "request_no",
                        stop_before=(F.col("status") != 200) | (F.array_size("jobs") == 0),
                        stop_after=~F.col("has_cursor"))
    rec = req.select("conv_id", "request_no", F.posexplode("jobs").alias("pos", "w")).select(
        "conv_id", "request_no", F.col("pos").cast("bigint").alias("pos"),
        F.when(F.length("w") > 2, F.col("w")).otherwise(F.lit("")).alias("job_id"),
        F.concat("w", F.lit("!")).alias("title"))
    kept = FT.cursor_merge(rec, "conv_id", "request_no", "pos", "job_id")
    return req, kept


_CURSOR_SQL = """
with req as (
  select conv_id, turn as request_no,
    case when turn = 6 and conv_id % 4 = 1 then []::varchar[] else string_split_regex(text, '\\s+') end as jobs,
    case when (conv_id + turn) % 9 = 8 then 500 else 200 end as status,
    (conv_id * 3 + turn) % 5 <> 0 as has_cursor
  from conversations),
flags as (
  select *,
    max(case when status <> 200 or len(jobs) = 0 then 1 else 0 end) over (
      partition by conv_id order by request_no rows between unbounded preceding and current row) as msb,
    coalesce(max(case when has_cursor then 0 else 1 end) over (
      partition by conv_id order by request_no rows between unbounded preceding and 1 preceding), 0) as msa
  from req),
kept_req as (select * from flags where msb = 0 and msa = 0),
rec as (
  select conv_id, request_no, pos, case when length(w) > 2 then w else '' end as job_id, w || '!' as title from (
    select conv_id, request_no, unnest(jobs) as w, unnest(range(len(jobs))) as pos from kept_req)),
merged as (
  select * from rec where job_id <> ''
  qualify row_number() over (partition by conv_id, job_id order by request_no, pos) = 1
  union all select * from rec where job_id = ''),
kept as (select * from merged)
"""


@query("cursor_merge_unique", _CURSOR_SQL + """
select conv_id, request_no, cast(pos as bigint) as pos, job_id, title from kept""")
def cursor_merge_unique(spark, d):
    """SRC-3/WIN-2/WIN-3/SRT-4: cursor pages merged per fetch, first occurrence per
    id, stop rules, the records with their fields."""
    _, kept = _cursor_merge(spark, d)
    return kept.select("conv_id", "request_no", "pos", "job_id", "title")


@query("fetch_batch_stats", _CURSOR_SQL + """
, stats as (
  select k.conv_id, k.request_no, cast(len(k.jobs) as bigint) as received,
    cast(coalesce(n.c, 0) as bigint) as new_added, k.has_cursor
  from kept_req k left join (select conv_id, request_no, count(*) as c from kept group by all) n
    using (conv_id, request_no)),
run as (select *, cast(sum(new_added) over (partition by conv_id order by request_no
          rows between unbounded preceding and current row) as bigint) as total_accumulated from stats)
select conv_id, request_no, received, new_added, total_accumulated, has_cursor from run""")
def fetch_batch_stats(spark, d):
    """AGG-6/WIN-6: per request made: received, new, running total, cursor flag."""
    req, kept = _cursor_merge(spark, d)
    req = req.select("conv_id", "request_no", F.array_size("jobs").alias("received"), "has_cursor")
    return FT.fetch_stats(req, kept, "conv_id", "request_no")


def page_bodies(spark, d):
    """Landed page-feed responses as JSON text: ``{data: [...], links: {next}}``;
    some planted non-object bodies, empty pages and last pages."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    page = F.col("turn") + 1
    nonobj = (F.col("conv_id") + F.col("turn")) % 11 == 10
    empty = (F.col("conv_id") % 6 == 5) & (F.col("turn") == 3)
    last = (F.col("conv_id") + 2 * F.col("turn")) % 7 == 0
    data = F.when(empty, F.array().cast("array<string>")).otherwise(_words())
    nxt = F.when(~last, F.concat(F.lit("?page="), (page + 1).cast("string")))
    body = F.when(nonobj, F.lit('"maintenance"')).otherwise(
        F.to_json(F.struct(data.alias("data"), F.struct(nxt.alias("next")).alias("links"))))
    return c.select("conv_id", page.alias("page_no"), body.alias("body"))


@query("page_prefix_merge", """
with pg as (
  select conv_id, turn + 1 as page_no,
    (conv_id + turn) % 11 = 10 as nonobj,
    case when conv_id % 6 = 5 and turn = 3 then []::varchar[] else string_split_regex(text, '\\s+') end as data,
    (conv_id + 2 * turn) % 7 = 0 as last
  from conversations),
flags as (
  select *,
    max(case when nonobj or len(data) = 0 then 1 else 0 end) over (
      partition by conv_id order by page_no rows between unbounded preceding and current row) as msb,
    coalesce(max(case when last then 1 else 0 end) over (
      partition by conv_id order by page_no rows between unbounded preceding and 1 preceding), 0) as msa
  from pg)
select conv_id, page_no, cast(pos as bigint) as pos, item from (
  select conv_id, cast(page_no as bigint) as page_no, unnest(data) as item, unnest(range(len(data))) as pos
  from flags where msb = 0 and msa = 0)""")
def page_prefix_merge(spark, d):
    """SRC-2/WIN-3: a fetch's pages concatenated; stop before a non-object or empty page,
    stop after a page without ``links.next``."""
    p = page_bodies(spark, d)
    v = J.parse("body")
    staged = p.select("conv_id", "page_no", J.kind_of(v).startswith("OBJECT").alias("is_obj"),
                      F.try_variant_get(v, "$.data", "array<string>").alias("data"),
                      F.try_variant_get(v, "$.links.next", "string").alias("next"))
    kept = FT.take_while(staged, "conv_id", "page_no",
                         stop_before=~F.col("is_obj") | F.coalesce(F.array_size("data") == 0, F.lit(True)),
                         stop_after=F.coalesce(F.length("next") == 0, F.lit(True)))
    return kept.select("conv_id", F.col("page_no").cast("bigint").alias("page_no"),
                       F.posexplode("data").alias("pos", "item")).select(
        "conv_id", "page_no", F.col("pos").cast("bigint").alias("pos"), "item")


def envelopes(spark, d):
    """Landed search responses in three shapes (object/object, object/array, bare array)."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    jobs = F.transform(_words(), lambda w: F.struct(w.alias("job_id")))
    cursor = F.when((F.col("conv_id") * 3 + F.col("turn")) % 5 != 0,
                    F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")))
    shape = F.col("turn") % 3
    body = (F.when(shape == 0, F.to_json(F.struct(
                F.lit("OK").alias("status"),
                F.struct(jobs.alias("jobs"), cursor.alias("cursor")).alias("data")), {"ignoreNullFields": "false"}))
            .when(shape == 1, F.to_json(F.struct(jobs.alias("data"))))
            .otherwise(F.to_json(jobs)))
    return c.select("conv_id", "turn", body.alias("body"))


@query("envelope_unwrap", """
select conv_id, turn, cast(pos as bigint) as pos, job_id,
  case when turn % 3 = 0 and (conv_id * 3 + turn) % 5 <> 0
       then 'c' || cast(conv_id as varchar) || '-' || cast(turn as varchar) end as cursor
from (select conv_id, turn, unnest(w) as job_id, unnest(range(len(w))) as pos
      from (select conv_id, turn, string_split_regex(text, '\\s+') as w from conversations))""")
def envelope_unwrap(spark, d):
    """SRC-4: jobs and cursor out of the three response shapes."""
    e = envelopes(spark, d).select("conv_id", "turn", FT.unwrap_envelope(F.col("body")).alias("u"))
    return e.select("conv_id", "turn", F.col("u.cursor").alias("cursor"),
                    F.posexplode("u.jobs").alias("pos", "j")).select(
        "conv_id", "turn", F.col("pos").cast("bigint").alias("pos"),
        F.try_variant_get("j", "$.job_id", "string").alias("job_id"), "cursor")
