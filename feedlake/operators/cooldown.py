"""Identity cooldown state (STR-5), availability (STR-6) and ladder outcome (STR-7).

Sequential rule per identity, events in (ts, id) order: a block on an
available identity starts a cooldown until ``ts + C`` and counts; blocks
during a cooldown change nothing; the identity is available again at
``ts >= cooldown_until``. So the counted blocks form a chain: the first event,
then repeatedly the first event at or after ``previous + C``.

Distributed form, without collecting an identity's events anywhere:

1. ``successor``: for every event, the first event of the same key at or after
   ``ts + C`` (an as-of lookup). Events and probes are sorted together inside
   fine time buckets; a probe whose bucket holds no later event takes the
   first event of the next non-empty bucket from a per-(key, bucket) summary.
   Windows are partitioned by (key, bucket), so a key with a huge share of
   all events is still spread over many tasks.
2. ``chain``: the events reachable from each key's first event through the
   successor pointer, found by pointer doubling: jump tables for 1, 2, 4, ...
   steps and a reachable set that absorbs each jump size once. The number
   of rounds is log2 of the longest possible chain (time span / C), a bound
   computed with one aggregate. Every table is checkpointed to the shared
   checkpoint folder so a lost executor recomputes one round only.
3. ``prefix_counts``: how many points of a key lie at or before each query
   time, from per-bucket running counts plus a running sum over bucket totals.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions import rules as R

US = 1_000_000


def _us(ts: str):
    return F.timestamp_diff("MICROSECOND", R.epoch_ntz(), F.col(ts))


def _checkpoint(df: DataFrame) -> DataFrame:
    from feedlake.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def successor(events: DataFrame, key: str, ts: str, eid: str, delta_s: float,
              bucket_s: float = 3600.0) -> DataFrame:
    """(key, eid, us, nxt): ``nxt`` = id of the first event (by time, then id) of the
    same key with time >= own time + ``delta_s`` (NULL if none)."""
    d = int(delta_s * US)
    w_us = int(bucket_s * US)
    ev = events.select(key, eid, _us(ts).alias("_t"))
    tg = ev.select(key, F.col("_t"), F.lit(1).alias("_k"), F.col(eid).alias("_tid"), F.lit(None).cast(
        ev.schema[eid].dataType).alias("_src"))
    pr = ev.select(key, (F.col("_t") + d).alias("_t"), F.lit(0).alias("_k"),
                   F.lit(None).cast(ev.schema[eid].dataType).alias("_tid"), F.col(eid).alias("_src"))
    u = tg.unionByName(pr).withColumn("_b", F.floor(F.col("_t") / w_us))
    # Reverse order: the nearest later target becomes the last target seen so far.
    w = (Window.partitionBy(key, "_b").orderBy(F.desc("_t"), F.desc("_k"), F.desc("_tid"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inb = (u.withColumn("_hit", F.last(F.when(F.col("_k") == 1, F.col("_tid")), ignorenulls=True).over(w))
           .where(F.col("_k") == 0).select(key, "_b", "_src", "_hit"))
    # first event of each non-empty bucket, and for any bucket the next non-empty one's first event
    firsts = ev.withColumn("_b", F.floor(F.col("_t") / w_us)).groupBy(key, "_b").agg(
        F.min(F.struct("_t", eid)).alias("_f"))
    probe_b = inb.where(F.col("_hit").isNull()).select(key, "_b").distinct()
    marks = (firsts.select(key, "_b", F.col(f"_f.{eid}").alias("_fid"), F.lit(1).alias("_k"))
             .unionByName(probe_b.select(key, "_b", F.lit(None).cast(ev.schema[eid].dataType).alias("_fid"),
                                         F.lit(0).alias("_k"))))
    # reversed bucket order, a bucket's probe marker before its own first event,
    # so only strictly later buckets are seen
    wb = (Window.partitionBy(key).orderBy(F.desc("_b"), F.asc("_k"))
          .rowsBetween(Window.unboundedPreceding, -1))
    nextb = (marks.withColumn("_nf", F.last("_fid", ignorenulls=True).over(wb))
             .where(F.col("_k") == 0).select(key, "_b", "_nf"))
    resolved = (inb.join(nextb, [key, "_b"], "left")
                .select(key, F.col("_src").alias(eid), F.coalesce("_hit", "_nf").alias("nxt")))
    return ev.select(key, eid, F.col("_t").alias("us")).join(resolved, [key, eid], "left")


def chain(events: DataFrame, key: str, ts: str, eid: str, delta_s: float, bucket_s: float = 3600.0) -> DataFrame:
    """STR-5: the counted blocks per key: (key, eid, us) of every event on the chain."""
    succ = _checkpoint(successor(events, key, ts, eid, delta_s, bucket_s))
    span = succ.groupBy(key).agg((F.max("us") - F.min("us")).alias("_span")).agg(F.max("_span")).first()[0]
    if span is None:
        return succ.select(key, eid, "us").limit(0)
    longest = int(span // int(delta_s * US)) + 1
    levels = max(1, math.ceil(math.log2(longest + 1)))
    jumps = [succ.select(key, F.col(eid).alias("_id"), F.col("nxt").alias("_to"))]
    for _ in range(1, levels):
        j = jumps[-1]
        nxt = (j.join(j.select(key, F.col("_id").alias("_to"), F.col("_to").alias("_to2")), [key, "_to"], "left")
               .select(key, "_id", F.col("_to2").alias("_to")))
        jumps.append(_checkpoint(nxt))
    start = succ.groupBy(key).agg(F.min(F.struct("us", eid)).alias("_s")).select(key, F.col(f"_s.{eid}").alias("_id"))
    reach = _checkpoint(start)
    for j in jumps:
        step = reach.join(j, [key, "_id"]).where(F.col("_to").isNotNull()).select(key, F.col("_to").alias("_id"))
        reach = _checkpoint(reach.unionByName(step).distinct())
    return succ.join(reach.select(key, F.col("_id").alias(eid)), [key, eid], "left_semi").select(key, eid, "us")


def cooldown_state(chained: DataFrame, key: str, delta_s: float) -> DataFrame:
    """Per key: counted blocks, first/last counted block, cooldown end."""
    d = int(delta_s * US)
    agg = chained.groupBy(key).agg(F.count(F.lit(1)).alias("block_count"), F.min("us").alias("_f"),
                                   F.max("us").alias("_l"))
    return agg.select(key, F.col("block_count").cast("bigint"), R.micros_to_ntz(F.col("_f")).alias("first_block"),
                      R.micros_to_ntz(F.col("_l")).alias("last_block"),
                      R.micros_to_ntz(F.col("_l") + d).alias("cooldown_until"))


def availability(identities: DataFrame, state: DataFrame, key: str, as_of, pool: str | None = None) -> DataFrame:
    """STR-6: per identity at ``as_of``: cooling or available (never blocked = available).

    With ``pool``, also whether it is its pool's first available one in key
    order, and whether all of the pool are cooling (an aggregate per pool).
    """
    j = identities.join(state, key, "left").withColumn("_free", F.coalesce(F.col("cooldown_until") <= as_of, F.lit(True)))
    cols = [key, F.coalesce("block_count", F.lit(0)).cast("bigint").alias("block_count"), "cooldown_until",
            F.col("_free").alias("available")]
    if pool is None:
        return j.select(*cols)
    firsts = j.groupBy(pool).agg(F.min(F.when(F.col("_free"), F.col(key))).alias("_first"))
    return j.join(firsts, pool).select(pool, *cols, F.coalesce(F.col("_first") == F.col(key), F.lit(False)).alias("first_available"),
                                       F.col("_first").isNull().alias("all_cooling"))


def prefix_counts(points: DataFrame, queries: DataFrame, key: str, bucket_us: int) -> DataFrame:
    """For each query (key, qid, q_us): number of points (key, p_us) with p_us <= q_us.

    Within a time bucket a running count (window per (key, bucket)); across
    buckets a running sum of bucket totals (window per key over one row per
    non-empty bucket). Returns (qid, n).
    """
    p = points.select(key, F.col("p_us").alias("_t")).withColumn("_b", F.floor(F.col("_t") / bucket_us))
    q = queries.select(key, "qid", F.col("q_us").alias("_t")).withColumn("_b", F.floor(F.col("_t") / bucket_us))
    qid_t = queries.schema["qid"].dataType
    u = (p.select(key, "_b", "_t", F.lit(0).alias("_k"), F.lit(None).cast(qid_t).alias("qid"))
         .unionByName(q.select(key, "_b", "_t", F.lit(1).alias("_k"), "qid")))
    w = Window.partitionBy(key, "_b").orderBy("_t", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inb = (u.withColumn("_c", F.sum(F.when(F.col("_k") == 0, 1).otherwise(0)).over(w))
           .where(F.col("_k") == 1).select(key, "_b", "qid", "_c"))
    totals = p.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(1))
    qb = q.select(key, "_b").distinct().withColumn("_n", F.lit(0).cast("bigint")).withColumn("_k", F.lit(0))
    wb = Window.partitionBy(key).orderBy("_b", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = (totals.unionByName(qb).withColumn("_cum", F.sum("_n").over(wb))
              .where(F.col("_k") == 0).select(key, "_b", "_cum"))
    return inb.join(before, [key, "_b"]).select("qid", (F.col("_c") + F.col("_cum")).cast("bigint").alias("n"))


def ladder_outcome(incidents: DataFrame, counted: DataFrame, pools: DataFrame, pool: str, delta_s: float,
                   attempts: int = 3, throttle_s: float = 60.0, bucket_s: float = 3600.0) -> DataFrame:
    """STR-7: per incident (pool, qid, q_us): identities still cooling after the
    ladder's waiting (``attempts * throttle_s``), free ones, and recovered?

    ``counted``: counted blocks (pool, p_us); ``pools``: (pool, n_identities).
    Cooling at check time t = x + wait means a counted block a with
    t - C < a <= x, i.e. prefix(x) - prefix(x + wait - C).
    """
    wait = int(attempts * throttle_s * US)
    d = int(delta_s * US)
    b = int(bucket_s * US)
    q_hi = incidents.select(pool, F.struct(F.col("qid").alias("id"), F.lit("hi").alias("side")).alias("qid"),
                            F.col("q_us"))
    q_lo = incidents.select(pool, F.struct(F.col("qid").alias("id"), F.lit("lo").alias("side")).alias("qid"),
                            (F.col("q_us") + wait - d).alias("q_us"))
    n = prefix_counts(counted, q_hi.unionByName(q_lo), pool, b)
    hi = n.where(F.col("qid.side") == "hi").select(F.col("qid.id").alias("_q"), F.col("n").alias("_hi"))
    lo = n.where(F.col("qid.side") == "lo").select(F.col("qid.id").alias("_q"), F.col("n").alias("_lo"))
    inc = incidents.withColumn("_q", F.col("qid"))
    j = inc.join(hi, "_q").join(lo, "_q").join(pools, pool)
    cooling = (F.col("_hi") - F.col("_lo")).cast("bigint")
    return j.select(*[c for c in incidents.columns if c != "q_us"], cooling.alias("cooling"),
                    (F.col("n_identities") - cooling).cast("bigint").alias("free_identities"),
                    (F.col("n_identities") - cooling > 0).alias("recovered"))
