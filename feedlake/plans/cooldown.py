"""Identity cooldown queries over ``events`` errors (identity = user, cooldown one day)."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.operators import cooldown as CD
from feedlake.plans.registry import query
from feedlake.sources.tables import table

COOLDOWN_S = 86400.0
AS_OF = "2024-01-20 12:00:00"
POOLS = 10


def _errors(spark, d, before: str | None = None):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type").where(
        F.col("event_type") == "error")
    if before is not None:
        e = e.where(F.col("ts") < F.lit(before).cast("timestamp_ntz"))
    return e.select("user_id", "ts", "event_id")


def _chain_sql(where: str = "") -> str:
    return f"""
with recursive errs as (select user_id, ts, event_id from events where event_type = 'error' {where}),
chain(user_id, ts, event_id) as (
  select user_id, ts, event_id from errs qualify row_number() over (partition by user_id order by ts, event_id) = 1
  union all
  select c.user_id, n.ts, n.event_id from chain c,
    lateral (select e.ts, e.event_id from errs e where e.user_id = c.user_id and e.ts >= c.ts + interval 86400 second
             order by e.ts, e.event_id limit 1) n)
"""


@query("identity_cooldown", _chain_sql() + """
select user_id, cast(count(*) as bigint) as block_count, min(ts) as first_block, max(ts) as last_block,
  max(ts) + interval 86400 second as cooldown_until
from chain group by user_id""")
def identity_cooldown(spark, d):
    """STR-5: counted blocks per identity under a one-day cooldown (sequential fold)."""
    ch = CD.chain(_errors(spark, d), "user_id", "ts", "event_id", COOLDOWN_S)
    return CD.cooldown_state(ch, "user_id", COOLDOWN_S)


@query("identity_availability", _chain_sql(f"and ts < timestamp '{AS_OF}'") + f"""
, st as (select user_id, count(*) as block_count, max(ts) + interval 86400 second as cooldown_until
         from chain group by user_id)
, av as (select u.user_id, u.user_id % {POOLS} as pool, cast(coalesce(block_count, 0) as bigint) as block_count, cooldown_until,
    coalesce(cooldown_until <= timestamp '{AS_OF}', true) as available
  from (select distinct user_id from events) u left join st using (user_id))
select *, available and user_id = min(user_id) filter (where available) over (partition by pool) as first_available,
  not bool_or(available) over (partition by pool) as all_cooling from av""")
def identity_availability(spark, d):
    """STR-6: which identities are available at a fixed time (state from earlier blocks)."""
    ch = CD.chain(_errors(spark, d, AS_OF), "user_id", "ts", "event_id", COOLDOWN_S)
    st = CD.cooldown_state(ch, "user_id", COOLDOWN_S)
    ids = table(spark, d, "events").select("user_id").distinct().withColumn("pool", F.col("user_id") % POOLS)
    return CD.availability(ids, st, "user_id", F.lit(AS_OF).cast("timestamp_ntz"), "pool")


@query("ladder_outcome", _chain_sql() + f"""
, pools as (select user_id % {POOLS} as pool, count(distinct user_id) as n from events group by 1),
inc as (select event_id, user_id, user_id % {POOLS} as pool, ts from errs),
cov as (
  select i.event_id, i.user_id, i.pool, count(c.ts) as cooling
  from inc i left join chain c on c.user_id % {POOLS} = i.pool and c.ts <= i.ts
    and c.ts > i.ts + interval 180 second - interval 86400 second
  group by all)
select pool, event_id, user_id, cast(cooling as bigint) as cooling, cast(n - cooling as bigint) as free_identities,
  n - cooling > 0 as recovered
from cov join pools using (pool)""")
def ladder_outcome(spark, d):
    """STR-7: per block incident, identities of its pool (user mod 10) still cooling
    after 3 x 60 s of waiting, and whether rotation could recover."""
    errs = _errors(spark, d)
    ch = CD.chain(errs, "user_id", "ts", "event_id", COOLDOWN_S)
    counted = ch.select((F.col("user_id") % POOLS).alias("pool"), F.col("us").alias("p_us"))
    incidents = errs.select((F.col("user_id") % POOLS).alias("pool"), F.col("event_id").alias("qid"),
                            F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"),
                                             F.col("ts")).alias("q_us"), "user_id")
    pools = (table(spark, d, "events").select((F.col("user_id") % POOLS).alias("pool"), "user_id").distinct()
             .groupBy("pool").agg(F.count(F.lit(1)).alias("n_identities")))
    out = CD.ladder_outcome(incidents, counted, pools, "pool", COOLDOWN_S, attempts=3, throttle_s=60.0)
    return out.select("pool", F.col("qid").alias("event_id"), "user_id", "cooling", "free_identities", "recovered")
