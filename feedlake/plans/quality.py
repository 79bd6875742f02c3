"""Quality-gate queries: landed payloads from ``events`` (50 ids per batch)."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions import text as TX
from feedlake.operators import quality as Q
from feedlake.operators.normalise import FLAT_REQUIRED
from feedlake.plans.listings import as_of_col
from feedlake.plans.registry import query
from feedlake.sources.tables import gate_payloads, table

REQUIRED = list(FLAT_REQUIRED)


def _scan(spark, d, attempt=1):
    p = gate_payloads(spark, d, attempt)
    return Q.scan_payloads(p, key_field="id")


def _verdicts(spark, d, attempt=1):
    manifest, records = _scan(spark, d, attempt)
    return manifest, records, Q.batch_verdicts(manifest, records, REQUIRED, min_items=1)


def _id(raw="raw"):
    return F.get_json_object(F.col(raw), "$.id").alias("id")


# The same batches, verdicts and records, written in SQL.
_GATE_SQL = """
with ev as (
  select event_id, event_id // 50 as batch_id,
    row_number() over (partition by event_id // 50 order by event_id) - 1 as pos,
    case when event_id % 211 = 0 and event_id % 307 = 0 then 'company,url'
         when event_id % 211 = 0 then 'url' when event_id % 307 = 0 then 'company' end as missing
  from events),
manifest as (
  select batch_id,
    case when batch_id % 19 <> 7 and batch_id % 17 = 5 then 'dict' else 'list' end as payload_type,
    case when batch_id % 19 = 7 or batch_id % 17 = 5 then 0 else count(*) end as n_items
  from ev group by batch_id),
rec as (select ev.* from ev join manifest using (batch_id) where payload_type = 'list' and n_items > 0),
firstbad as (select batch_id, min(pos) as pos, arg_min(missing, pos) as missing
  from rec where missing is not null group by batch_id),
verdict as (
  select m.batch_id, m.payload_type, m.n_items, f.pos as bad_pos,
    case when m.payload_type = 'list' and m.n_items >= 1 then f.missing end as missing,
    case when m.payload_type <> 'list' then 'Expected list, got ' || m.payload_type
         when m.n_items < 1 then 'Too few items: got ' || cast(m.n_items as varchar) || ', expected >= 1'
         when f.pos is not null then 'Item ' || cast(f.pos as varchar) || ' missing required keys: {'''
              || replace(f.missing, ',', ''', ''') || '''}'
    end as reason
  from manifest m left join firstbad f using (batch_id)),
passed as (select rec.* from rec join verdict using (batch_id) where reason is null)
"""


@query("scan_keyed_records", _GATE_SQL + """
select 'feed_a' as source, batch_id, cast(pos as bigint) as pos, cast(event_id as varchar) as id from rec""")
def scan_keyed_records(spark, d):
    """SRC-1: array payloads -> records that are objects with an id (metadata dropped)."""
    _, records = _scan(spark, d)
    return records.select("source", "batch_id", "pos", _id())


@query("payload_type_check", _GATE_SQL + """
select 'feed_a' as source, batch_id, payload_type, payload_type = 'list' as type_ok from manifest""")
def payload_type_check(spark, d):
    """VAL-1: payload must be a JSON array."""
    manifest, _ = _scan(spark, d)
    return manifest.select("source", "batch_id", "payload_type", (F.col("payload_type") == "list").alias("type_ok"))


@query("batch_min_items", _GATE_SQL + """
select 'feed_a' as source, batch_id, cast(n_items as bigint) as n_items, n_items >= 1 as count_ok from manifest""")
def batch_min_items(spark, d):
    """VAL-2: item count per batch (from the manifest, so empty batches remain) >= 1."""
    manifest, _ = _scan(spark, d)
    return manifest.select("source", "batch_id", "n_items", (F.col("n_items") >= 1).alias("count_ok"))


@query("required_keys_check", _GATE_SQL + """
select 'feed_a' as source, batch_id, cast(pos as bigint) as pos, missing from rec where missing is not null""")
def required_keys_check(spark, d):
    """VAL-3: every record missing a required key (presence check)."""
    _, records = _scan(spark, d)
    m = records.select("source", "batch_id", "pos", Q.missing_keys(F.col("raw"), REQUIRED).alias("m"))
    return m.where(F.array_size("m") > 0).select("source", "batch_id", "pos", F.array_join("m", ",").alias("missing"))


@query("batch_verdict", _GATE_SQL + """
select 'feed_a' as source, batch_id, reason is null as ok, reason, missing, cast(n_items as bigint) as n_items
from verdict""")
def batch_verdict(spark, d):
    """VAL-4: ordered checks, first failure wins; one row per batch."""
    _, _, v = _verdicts(spark, d)
    return v.select("source", "batch_id", "ok", "reason", F.array_join("missing", ",").alias("missing"), "n_items")


@query("gate_pass", _GATE_SQL + """
select 'feed_a' as source, batch_id, cast(pos as bigint) as pos, cast(event_id as varchar) as id from passed""")
def gate_pass(spark, d):
    """VAL-7: records of passing batches only."""
    _, records, v = _verdicts(spark, d)
    return Q.gate_pass(records, v).select("source", "batch_id", "pos", _id())


@query("gate_quarantine", _GATE_SQL + """
select 'feed_a' as source, batch_id, cast(pos as bigint) as pos, cast(event_id as varchar) as id, reason
from rec join verdict using (batch_id) where reason is not null""")
def gate_quarantine(spark, d):
    """VAL-7: records of failed batches with the batch reason."""
    _, records, v = _verdicts(spark, d)
    return Q.gate_quarantine(records, v).select("source", "batch_id", "pos", _id(), "reason")


@query("dead_letter_rows", _GATE_SQL + """
select 'feed_a' as source, v.batch_id, v.reason,
  coalesce((select string_agg(cast(event_id as varchar), ',' order by pos) from rec
            where rec.batch_id = v.batch_id and rec.pos < 3), '') as sample_ids,
  case when v.missing is not null then '{"missing":["' || replace(v.missing, ',', '","') || '"]}' end
    as details
from verdict v where v.reason is not null""")
def dead_letter_rows(spark, d):
    """SNK-2: one dead letter per failed batch with its first three records."""
    _, records, v = _verdicts(spark, d)
    dl = Q.dead_letters(records, v, as_of_col())
    return dl.select("source", "batch_id", "reason",
                     F.array_join(F.transform("raw_sample", lambda r: F.get_json_object(r, "$.id")), ",")
                     .alias("sample_ids"), "details")


@query("attempt_resolution", _GATE_SQL + """
, bad_any as (select batch_id, count(missing) as n_bad from ev group by batch_id),
v2 as (
  select batch_id,
    case when batch_id % 19 = 7 then 'Too few items: got 0, expected >= 1'
         when n_bad > 0 then 'missing keys' end as reason2
  from bad_any)
select 'feed_a' as source, batch_id,
  cast(case when v.reason is null then 1 when v2.reason2 is null then 2 end as bigint) as accepted_attempt,
  case when v.reason is null then 'ok' when v2.reason2 is null then 'recovered'
       else 'validation_failed_after_fallback' end as outcome,
  cast(case when v.reason is null then 0 else 1 end as bigint) as block_count,
  v.reason as first_reason
from verdict v join v2 using (batch_id)""")
def attempt_resolution(spark, d):
    """VAL-8: a second attempt after a failed first one; outcome per batch."""
    vs = []
    for attempt in (1, 2):
        _, _, v = _verdicts(spark, d, attempt)
        vs.append(v.withColumn("attempt", F.lit(attempt)))
    return Q.resolve_attempts(vs[0].unionByName(vs[1]))


def _passed_keys(spark, d):
    _, records, v = _verdicts(spark, d)
    return Q.record_keys(Q.gate_pass(records, v))


def _known_snapshot(passed_keys):
    """The snapshot taken from the first passing batch of each source."""
    per_batch = Q.snapshot_fields(passed_keys)
    return per_batch.groupBy("source").agg(F.min_by("fields", "batch_id").alias("fields"))


@query("schema_drift", _GATE_SQL + """
, keyed as (select batch_id, event_id, unnest(case when batch_id % 23 = 4 then ['id', 'position', 'company', 'url']
                                   else ['id', 'position', 'company', 'url', 'epoch'] end) as field from passed),
known as (select distinct field from keyed where batch_id = (select min(batch_id) from keyed)),
n as (select batch_id, count(*) as sample_n from passed group by batch_id),
has as (select batch_id, field, count(*) as c from keyed group by all),
vote as (select n.batch_id, known.field, n.sample_n, n.sample_n - coalesce(h.c, 0) as missing
         from n cross join known left join has h on h.batch_id = n.batch_id and h.field = known.field)
select 'feed_a' as source, batch_id, field, cast(missing as bigint) as missing, cast(sample_n as bigint) as sample_n
from vote where missing * 2 > sample_n""")
def schema_drift(spark, d):
    """VAL-6: fields absent from more than half of a batch's records."""
    keys = _passed_keys(spark, d)
    return Q.schema_drift(keys, _known_snapshot(keys))


@query("schema_snapshot", _GATE_SQL + """
select 'feed_a' as source, batch_id, 'company,epoch,id,position,url' as fields
from passed where batch_id % 23 <> 4 group by batch_id""")
def schema_snapshot(spark, d):
    """SNK-3: sorted field names of the first record of every passing, drift-free batch."""
    keys = _passed_keys(spark, d)
    drift = Q.schema_drift(keys, _known_snapshot(keys)).select(*Q.KEY).distinct()
    snap = Q.snapshot_fields(keys.join(drift, Q.KEY, "left_anti"))
    return snap.select("source", "batch_id", F.array_join("fields", ",").alias("fields"))


# ------------------------------------------------------------ pages / documents

_PLANT = ("case when page_id % 10 = 3 then concat(html, ' Please verify you are human') "
          "when page_id % 10 = 7 then concat('<h1>Access Denied</h1>', html) else html end")


def _planted_pages(spark, d):
    p = table(spark, d, "pages").select("page_id", "url", "html")
    return p.withColumn("html", F.expr(_PLANT))


_PHRASES_SQL = "[" + ", ".join(f"'{p}'" for p in TX.BLOCK_PHRASES) + "]"
_ANY_PHRASE = " or ".join(f"contains(h, '{p}')" for p in TX.BLOCK_PHRASES)


@query("block_page_detect", f"""
select page_id, ({_ANY_PHRASE}) as is_block from (select page_id, lower({_PLANT}) as h from pages)""")
def block_page_detect(spark, d):
    """VAL-5: block/CAPTCHA page flag per page (phrases planted in some pages)."""
    return Q.block_pages(_planted_pages(spark, d), "html").select("page_id", "is_block")


@query("block_page_hits", f"""
select p as phrase, count(*) as n_hits
from (select lower({_PLANT}) as h from pages), unnest({_PHRASES_SQL}) t(p)
where contains(h, p) group by p""")
def block_page_hits(spark, d):
    """VAL-5: pages containing each block phrase."""
    return Q.block_phrase_hits(_planted_pages(spark, d), "html")


@query("length_range_check", """
select doc_id, cast(length(text) as bigint) as n_chars,
  case when length(text) < 500 then 'too_short' when length(text) > 50000 then 'too_long' else 'ok' end
    as length_status
from documents""")
def length_range_check(spark, d):
    """VAL-9: content length within 500..50000 characters."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return Q.length_check(docs, "text", 500, 50000).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), "length_status")


_SIZED_TEXT = "case when doc_id % 74 = 1 then '' when doc_id % 82 = 3 then repeat(text, 50) else text end"


@query("learned_size_check", f"""
with sizes as (select doc_id, source, cast(length(t) as bigint) as n_chars, cast(len(string_split(t, ' ')) as bigint) as n_elements
               from (select doc_id, source, {_SIZED_TEXT} as t from documents)),
learned as (select source, quantile_disc(n_chars, 0.01) / 2.0 as c0, quantile_disc(n_chars, 0.99) * 2.0 as c1,
              quantile_disc(n_elements, 0.01) / 2.0 as e0, quantile_disc(n_elements, 0.99) * 2.0 as e1
            from sizes where doc_id % 2 = 0 group by source)
select doc_id, source, n_chars, n_elements,
  case when c0 is null then 'unknown' when n_chars < c0 then 'too_few' when n_chars > c1 then 'too_many' else 'ok' end as n_chars_status,
  case when e0 is null then 'unknown' when n_elements < e0 then 'too_few' when n_elements > e1 then 'too_many' else 'ok' end as n_elements_status
from sizes left join learned using (source) where doc_id % 2 = 1""")
def learned_size_check(spark, d):
    """VAL-9: lengths and element counts of odd documents against ranges learned from even ones, in two merged parts per
    source; some odd ones are planted empty or fiftyfold."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.expr(_SIZED_TEXT).alias("t"))
    sizes = docs.select("doc_id", "source", F.length("t").cast("bigint").alias("n_chars"), F.size(F.split("t", " ")).cast("bigint").alias("n_elements"))
    by, measures = ["source"], ["n_chars", "n_elements"]
    parts = [Q.size_sketches(sizes.where(f"doc_id % 4 = {r}"), by, measures) for r in (0, 2)]
    history = Q.merge_sketches(parts[0].unionByName(parts[1]), by, measures)
    return Q.learned_range_check(sizes.where("doc_id % 2 = 1"), history, by, measures)


_FINAL_URL = "case when page_id % 9 = 4 then regexp_replace(url, '://[^/?#]+', '://redirect.example') else url end"


@query("unexpected_redirect", f"""
select page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]+)', 1))
  <> lower(regexp_extract({_FINAL_URL}, '^[A-Za-z]+://([^/?#:]+)', 1)) as unexpected_redirect
from pages""")
def unexpected_redirect(spark, d):
    """VAL-9: final URL host differs from the requested host (planted redirects)."""
    p = table(spark, d, "pages").select("page_id", "url").withColumn("final_url", F.expr(_FINAL_URL))
    return Q.redirect_check(p, "url", "final_url").select("page_id", "unexpected_redirect")
