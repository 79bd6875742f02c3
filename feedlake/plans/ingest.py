"""Upsert queries (events split by date) and operations reports over the gate batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from feedlake.operators import ops as O
from feedlake.operators import quality as Q
from feedlake.operators import snapshots as S
from feedlake.operators import upsert as U
from feedlake.plans.quality import _GATE_SQL, REQUIRED, _known_snapshot, _verdicts
from feedlake.plans.registry import query
from feedlake.plans.sql import LISTINGS_CTE
from feedlake.session import ensure_checkpoint_dir
from feedlake.sources.tables import GATE_BATCH, gate_payloads, listings, table

KEYS = ["event_type", "user_id"]
ORDER = ["ts", "event_id"]
SPLIT = "2024-01-16 00:00:00"


def _events(spark, d):
    return table(spark, d, "events").select("event_type", "user_id", "event_id", "ts", "value")


def _old_new(spark, d):
    e = _events(spark, d)
    cut = F.lit(SPLIT).cast("timestamp_ntz")
    old = U.latest_per_key(e.where(F.col("ts") < cut).withColumn("batch", F.lit("old")), KEYS, ORDER)
    new = e.where(F.col("ts") >= cut).withColumn("batch", F.lit("new"))
    return old, new


_UPS_SQL = f"""
with o as (select *, row_number() over (partition by event_type, user_id order by ts desc, event_id desc) rn
           from events where ts < timestamp '{SPLIT}'),
n as (select *, row_number() over (partition by event_type, user_id order by ts desc, event_id desc) rn
      from events where ts >= timestamp '{SPLIT}'),
old as (select event_type, user_id, event_id, ts, value, 'old' as batch from o where rn = 1),
new as (select event_type, user_id, event_id, ts, value, 'new' as batch from n where rn = 1),
merged as (select * from old where (event_type, user_id) not in (select event_type, user_id from new)
           union all select * from new),
counts as (select count(*) as success_count,
  (select count(*) from (select distinct event_type, user_id from n) k
   where (event_type, user_id) not in (select event_type, user_id from old)) as insert_count from n)
"""


@query("upsert_snapshot", _UPS_SQL + "select * from merged")
def upsert_snapshot(spark, d):
    """UPS-1/2, WIN-7: snapshot of days 1-15 upserted with days 16-30 on (event_type, user_id)."""
    old, new = _old_new(spark, d)
    return U.merge(old, new, KEYS, ORDER)


LATE = "event_id % 5 = 0"


@query("upsert_event_time", f"""
with e as (select event_type, user_id, event_id, value, ts >= timestamp '{SPLIT}' as is_new,
             case when ts >= timestamp '{SPLIT}' and {LATE} then ts - interval 12 days else ts end as ts from events),
old as (select * from e where not is_new qualify row_number() over (partition by event_type, user_id order by ts desc, event_id desc) = 1),
new as (select * from e where is_new qualify row_number() over (partition by event_type, user_id order by ts desc, event_id desc) = 1)
select event_type, user_id, event_id, ts, value, case when is_new then 'new' else 'old' end as batch
from (select * from old union all select * from new)
qualify row_number() over (partition by event_type, user_id order by ts desc, is_new desc) = 1""")
def upsert_event_time(spark, d):
    """UPS-1 with the event-time flag: every fifth record of days 16-30 comes 12 days late and loses to newer stored ones."""
    old, new = _old_new(spark, d)
    late = F.when(F.expr(LATE), F.timestamp_add("DAY", F.lit(-12), F.col("ts"))).otherwise(F.col("ts"))
    return U.merge(old, new.withColumn("ts", late), KEYS, ["event_id"], event_time="ts")


@query("snapshot_deltas", """
select event_type, user_id, event_id, ts, value from events
qualify row_number() over (partition by event_type, user_id order by event_id % 6 desc, ts desc, event_id desc) = 1""")
def snapshot_deltas(spark, d):
    """UPS-1/STR-3: six batches upserted one by one into a stored snapshot, read back by merging deltas with split buckets."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/snapshots/{uuid.uuid4().hex}"
    e = _events(spark, d)
    for n in range(6):
        S.upsert(spark, e.where(F.col("event_id") % 6 == n), root, n, KEYS, ORDER, policy=S.Policy(limit=20_000, least=500, share=0.5))
    return S.read(spark, root, KEYS).select("event_type", "user_id", "event_id", "ts", "value")


@query("upsert_counts", _UPS_SQL + """
select cast(success_count as bigint) as success_count, cast(insert_count as bigint) as insert_count,
  cast(success_count - insert_count as bigint) as update_count from counts""")
def upsert_counts(spark, d):
    """UPS-3: success / insert / update counters of the second batch."""
    old, new = _old_new(spark, d)
    return U.upsert_counts(old, new, KEYS)


@query("upsert_idempotent", _UPS_SQL + """
select 'rows_after_first' as metric, cast(count(*) as bigint) as value from merged
union all select 'rows_after_second', cast(count(*) as bigint) from merged
union all select 'insert_second', cast(0 as bigint)
union all select 'update_second', cast(success_count as bigint) from counts""")
def upsert_idempotent(spark, d):
    """UPS-4: applying the same batch twice changes nothing; the second run only updates."""
    old, new = _old_new(spark, d)
    first = U.merge(old, new, KEYS, ORDER)
    second = U.merge(first, new, KEYS, ORDER)
    c2 = U.upsert_counts(first, new, KEYS)
    return (first.agg(F.count(F.lit(1)).alias("value")).select(F.lit("rows_after_first").alias("metric"), "value")
            .unionByName(second.agg(F.count(F.lit(1)).alias("value"))
                         .select(F.lit("rows_after_second").alias("metric"), "value"))
            .unionByName(c2.select(F.lit("insert_second").alias("metric"), F.col("insert_count").alias("value")))
            .unionByName(c2.select(F.lit("update_second").alias("metric"), F.col("update_count").alias("value")))
            .select("metric", F.col("value").cast("bigint")))


@query("key_uniqueness_audit", _UPS_SQL + """
select 'batch' as scope, event_type, user_id, count(*) as n from n group by all having count(*) > 1
union all
select 'snapshot', event_type, user_id, count(*) from merged group by all having count(*) > 1""")
def key_uniqueness_audit(spark, d):
    """UPS-5: duplicate keys in the raw batch (expected) and in the snapshot (must be none)."""
    old, new = _old_new(spark, d)
    merged = U.merge(old, new, KEYS, ORDER)
    return (U.duplicate_keys(new, KEYS).select(F.lit("batch").alias("scope"), *KEYS, "n")
            .unionByName(U.duplicate_keys(merged, KEYS).select(F.lit("snapshot").alias("scope"), *KEYS, "n")))


# ------------------------------------------------------------ run log over the gate batches

def run_logs(spark, d):
    """The run log of one cycle over all gate batches (attempts, drift, upsert).

    The second attempt is built and scanned only for the batches whose first one
    failed. Manifests and records of each attempt are parsed once and
    checkpointed in the shared folder; all else reads those copies.
    """
    from feedlake.operators.dedup import _checkpoint

    e = table(spark, d, "events").select("event_id", "ts")
    batches = e.groupBy(F.floor(F.col("event_id") / GATE_BATCH).cast("bigint").alias("batch_id")).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("finished_at")).withColumn("source", F.lit("feed_a"))
    ka = Q.KEY + ["attempt"]

    def attempt(n, payloads):
        m, r = Q.scan_payloads(payloads, key_field="id")
        r = _checkpoint(r.withColumn("attempt", F.lit(n)))
        return r, _checkpoint(Q.batch_verdicts(m.withColumn("attempt", F.lit(n)), r, REQUIRED, key=ka))

    first, v1 = attempt(1, gate_payloads(spark, d, 1))
    again = gate_payloads(spark, d, 2).join(v1.where(~F.col("ok")).select(*Q.KEY), Q.KEY, "left_semi")
    second, v2 = attempt(2, again)
    records, verdicts = first.unionByName(second), v1.unionByName(v2)
    res = Q.resolve_attempts(verdicts)
    accepted = records.join(res.select(*Q.KEY, F.col("accepted_attempt").cast("int").alias("attempt")), ka,
                            "left_semi")
    keyed = Q.record_keys(accepted)
    first_pass = first.join(v1.where("ok").select(*Q.KEY), Q.KEY, "left_semi")
    known = _known_snapshot(Q.record_keys(first_pass))
    drift = Q.schema_drift(keyed, known)
    written = (accepted.join(drift.select(*Q.KEY).distinct(), Q.KEY, "left_anti")
               .select(*Q.KEY, F.get_json_object("raw", "$.id").alias("external_id")))
    inserts = O.first_batch_inserts(written, None, ["source", "external_id"])
    return O.run_log(batches, res, drift, written, inserts)


_RUNLOG_SQL = _GATE_SQL + """
, bad_any as (select batch_id, count(missing) as n_bad from ev group by batch_id),
v2 as (select batch_id, case when batch_id % 19 = 7 then 'empty' when n_bad > 0 then 'missing' end as reason2
       from bad_any),
bt as (select event_id // 50 as batch_id, min(ts) as started_at, max(ts) as finished_at, count(*) as n
       from events group by 1),
res as (select batch_id, case when v.reason is null then 1 when v2.reason2 is null then 2 end as acc,
          v.reason is not null as blocked, v.reason as reason
        from verdict v join v2 using (batch_id)),
runlog as (
  select 'feed_a' as source, batch_id, started_at, finished_at,
    cast(case when acc is null or batch_id % 23 = 4 then 0 else n end as bigint) as success_count,
    cast(case when acc is null or batch_id % 23 = 4 then 0 else n end as bigint) as insert_count,
    cast(0 as bigint) as update_count,
    cast(case when blocked then 1 else 0 end as bigint) as block_count,
    acc is not null and batch_id % 23 = 4 as schema_drift,
    case when acc is null then 'validation_failed_after_fallback'
         when batch_id % 23 = 4 then 'schema_drift' end as error
  from bt join res using (batch_id))
"""


@query("run_log", _RUNLOG_SQL + "select * from runlog")
def run_log(spark, d):
    """AGG-1: per-batch counters (success, insert, update, block, drift, error)."""
    return run_logs(spark, d)


@query("cycle_summary", _RUNLOG_SQL + """
select cast(count(*) as bigint) as runs, cast(sum(success_count) as bigint) as total_listings,
  cast(sum(insert_count) as bigint) as new_inserts, cast(sum(update_count) as bigint) as updates,
  cast(count(error) as bigint) as n_errors,
  array_to_string(list_sort(list_distinct(list(error))), '; ') as error_kinds,
  round(date_diff('microsecond', min(started_at), max(finished_at)) / 1e6, 1) as duration_s
from runlog""")
def cycle_summary(spark, d):
    """AGG-2: totals of the cycle."""
    return O.cycle_summary(run_logs(spark, d))


@query("recent_runs", _RUNLOG_SQL + """
select * from runlog order by started_at desc nulls last, source, batch_id limit 10""")
def recent_runs(spark, d):
    """SRC-6/SRT-2: ten newest run-log rows."""
    return O.recent(run_logs(spark, d), "started_at", 10, ["source", "batch_id"])


@query("recent_dead_letters", _RUNLOG_SQL + """
, dl as (
  select 'feed_a' as source, batch_id, reason, finished_at as recorded_at from res join bt using (batch_id)
  where blocked
  union all
  select 'feed_a', batch_id, 'schema_drift', finished_at from runlog where schema_drift)
select * from dl order by recorded_at desc nulls last, source, batch_id, reason limit 50""")
def recent_dead_letters(spark, d):
    """SRC-7/SRT-3: fifty newest dead letters (validation failures and drift)."""
    logs = run_logs(spark, d)
    _, r1, v1 = _verdicts(spark, d)
    times = logs.select(*Q.KEY, F.col("finished_at").alias("recorded_at"))
    dl_val = Q.dead_letters(r1, v1, F.lit(None).cast("timestamp_ntz")).drop("recorded_at").join(times, Q.KEY)
    dl_drift = logs.where("schema_drift").select(*Q.KEY, F.lit("schema_drift").alias("reason"),
                                                 F.col("finished_at").alias("recorded_at"))
    both = dl_val.select(*Q.KEY, "reason", "recorded_at").unionByName(dl_drift)
    return O.recent(both, "recorded_at", 50, ["source", "batch_id", "reason"])


@query("run_report", _RUNLOG_SQL + """
select source, batch_id,
  coalesce(strftime(started_at, '%Y-%m-%d %H:%M:%S') || ' UTC', '—') as started_text,
  coalesce(strftime(finished_at, '%Y-%m-%d %H:%M:%S') || ' UTC', '—') as finished_text,
  case when error is null then 'ok' else 'error' end as status,
  substring(coalesce(error, '—'), 1, 80) as detail_text
from runlog""")
def run_report(spark, d):
    """F-14/F-15: printable run rows."""
    return O.run_report(run_logs(spark, d))


@query("source_health", _RUNLOG_SQL + """
select source, date_trunc('day', started_at) as period, cast(count(*) as bigint) as runs,
  round(avg(case when error is null then 1.0 else 0.0 end), 4) as success_rate,
  round(avg(case when block_count > 0 then 1.0 else 0.0 end), 4) as block_rate,
  cast(count(*) filter (where schema_drift) as bigint) as drift_count,
  round(avg(date_diff('microsecond', started_at, finished_at) / 1e6), 3) as avg_latency_s
from runlog group by all""")
def source_health(spark, d):
    """AGG-10: daily health per source from the run log."""
    return O.source_health(run_logs(spark, d))


@query("source_inventory", LISTINGS_CTE + """
, reg as (select * from (values ('feed_a', 1, true), ('feed_b', 2, true), ('feed_c', 3, false))
          t(source, priority, enabled))
select reg.source, cast(priority as bigint) as priority, enabled, cast(coalesce(n, 0) as bigint) as n_listings
from reg left join (select source, count(*) as n from listings group by source) c using (source)""")
def source_inventory(spark, d):
    """SRC-9/AGG-3/JON-5: registered feeds (priority, enabled) with their listing counts."""
    return O.source_inventory(O.registry_frame(spark), listings(spark, d))


# ------------------------------------------------------------ gaps per user

_GAPS_SQL = """
with g as (select user_id,
  (epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id))) / 1e6 as gap_s
  from events)
"""


def _gaps(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id")
    return O.consecutive_gaps(e, "user_id", "ts", "event_id", bucket_seconds=3600)


@query("crawl_delay_audit", _GAPS_SQL + """
select user_id, count(*) as n_gaps, count(*) filter (where gap_s < 60) as n_short, round(min(gap_s), 3) as min_gap_s
from g where gap_s is not null group by user_id""")
def crawl_delay_audit(spark, d):
    """WIN-5: per identity, request gaps below the 60 s crawl delay."""
    return O.crawl_delay_audit(_gaps(spark, d), "user_id", 60.0)


@query("gap_statistics", _GAPS_SQL + """
select user_id, count(*) as n_gaps, round(avg(gap_s), 3) as mean_s, round(median(gap_s), 3) as median_s,
  round(stddev_samp(gap_s), 3) as stddev_s, round(min(gap_s), 3) as min_s, round(max(gap_s), 3) as max_s
from g where gap_s is not null group by user_id""")
def gap_statistics(spark, d):
    """AGG-11: request-gap distribution per identity."""
    return O.gap_statistics(_gaps(spark, d), "user_id")

