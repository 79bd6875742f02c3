"""Operations tables and reports: run logs, cycle totals, health, inventory, gaps.

Everything here is an aggregation over (small) per-batch rows or a keyed
aggregation of records with map-side combining. Ordered per-key work (gaps
between consecutive events) is split by time bucket so that one hot key is
spread over many tasks; only one row per (key, bucket) crosses buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlake.functions import rules as R
from feedlake.operators.normalise import REGISTRY

KEY = ["source", "batch_id"]


# ------------------------------------------------------------ AGG-1 run log

def first_batch_inserts(written: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """UPS-3 over a sequence of batches: inserts per batch = keys first written in it.

    ``written``: records actually upserted (source, batch_id, *keys); batches
    are applied in ``batch_id`` order. A key already in ``target`` is never an
    insert. Aggregations only: ``min(batch_id)`` per key, then a count.
    """
    first = written.groupBy(*keys).agg(F.min("batch_id").alias("batch_id"))
    if target is not None:
        first = first.join(target.select(*keys).distinct(), keys, "left_anti")
    return first.groupBy("source", "batch_id").agg(F.count(F.lit(1)).alias("insert_count"))


def run_log(batches: DataFrame, resolution: DataFrame, drift: DataFrame, written: DataFrame,
            inserts: DataFrame) -> DataFrame:
    """AGG-1: one run-log row per (source, batch).

    ``batches``: (source, batch_id, started_at, finished_at); ``resolution``:
    output of ``quality.resolve_attempts``; ``drift``: (source, batch_id) of
    drifted batches; ``written``: upserted records; ``inserts``: from
    ``first_batch_inserts``.
    """
    succ = written.groupBy(*KEY).agg(F.count(F.lit(1)).alias("success_count"))
    d = drift.select(*KEY).distinct().withColumn("_drift", F.lit(True))
    j = (batches.join(resolution, KEY, "left").join(d, KEY, "left").join(succ, KEY, "left")
         .join(inserts, KEY, "left"))
    drifted = F.coalesce(F.col("_drift"), F.lit(False))
    accepted = F.col("accepted_attempt").isNotNull()
    s = F.when(accepted & ~drifted, F.coalesce(F.col("success_count"), F.lit(0))).otherwise(0)
    i = F.when(accepted & ~drifted, F.coalesce(F.col("insert_count"), F.lit(0))).otherwise(0)
    return j.select(
        *KEY, "started_at", "finished_at",
        s.cast("bigint").alias("success_count"), i.cast("bigint").alias("insert_count"),
        (s - i).cast("bigint").alias("update_count"),
        F.coalesce(F.col("block_count"), F.lit(0)).cast("bigint").alias("block_count"),
        (accepted & drifted).alias("schema_drift"),
        F.when(~accepted, F.lit("validation_failed_after_fallback"))
        .when(drifted, F.lit("schema_drift")).alias("error"))


def cycle_summary(logs: DataFrame) -> DataFrame:
    """AGG-2: totals of a cycle; error kinds (distinct, sorted); duration to 0.1 s.

    A kind is an error's text up to its first colon with numbers as ``#``, so that
    messages which name an item or its keys are one kind.
    """
    kind = F.regexp_replace(F.substring_index("error", ":", 1), "[0-9]+", "#")
    dur = F.timestamp_diff("MICROSECOND", F.min("started_at"), F.max("finished_at")) / F.lit(1e6)
    return logs.agg(
        F.count(F.lit(1)).cast("bigint").alias("runs"),
        F.coalesce(F.sum("success_count"), F.lit(0)).cast("bigint").alias("total_listings"),
        F.coalesce(F.sum("insert_count"), F.lit(0)).cast("bigint").alias("new_inserts"),
        F.coalesce(F.sum("update_count"), F.lit(0)).cast("bigint").alias("updates"),
        F.count("error").cast("bigint").alias("n_errors"),
        F.array_join(F.array_sort(F.collect_set(kind)), "; ").alias("error_kinds"),
        F.round(dur, 1).alias("duration_s"))


def recent(df: DataFrame, ts_col: str, n: int, tie: list[str]) -> DataFrame:
    """SRC-6/7, SRT-2/3: newest ``n`` rows (bounded top-k)."""
    return df.orderBy(F.desc_nulls_last(ts_col), *[F.asc(c) for c in tie]).limit(n)


def run_report(logs: DataFrame, width: int = 80) -> DataFrame:
    """F-14/F-15: printable run rows (UTC timestamps, em dash for NULL, cut details)."""
    return logs.select(
        *KEY, R.format_ts(F.col("started_at")).alias("started_text"),
        R.format_ts(F.col("finished_at")).alias("finished_text"),
        F.when(F.col("error").isNull(), F.lit("ok")).otherwise(F.lit("error")).alias("status"),
        F.substring(F.coalesce(F.col("error"), F.lit("—")), 1, width).alias("detail_text"))


def health_metrics() -> list[Column]:
    """Runs, success rate, block rate, drift count and latency of a group of run logs."""
    lat = F.timestamp_diff("MICROSECOND", F.col("started_at"), F.col("finished_at")) / F.lit(1e6)
    return [F.count(F.lit(1)).cast("bigint").alias("runs"),
            F.round(F.avg(F.col("error").isNull().cast("double")), 4).alias("success_rate"),
            F.round(F.avg((F.col("block_count") > 0).cast("double")), 4).alias("block_rate"),
            F.count_if("schema_drift").cast("bigint").alias("drift_count"),
            F.round(F.avg(lat), 3).alias("avg_latency_s")]


def source_health(logs: DataFrame, period: str = "day") -> DataFrame:
    """AGG-10: per source and period: runs, success rate, block rate, drift count, latency."""
    return logs.withColumn("period", F.date_trunc(period, "started_at")).groupBy("source", "period").agg(*health_metrics())


def registry_frame(spark: SparkSession) -> DataFrame:
    """SRC-9: the feed registry as a (tiny, fixed-size) DataFrame."""
    rows = [(s.source_id, s.priority, s.enabled, s.label) for s in REGISTRY.values()]
    return spark.createDataFrame(rows, "source string, priority int, enabled boolean, label string")


def source_inventory(registry: DataFrame, listings: DataFrame) -> DataFrame:
    """AGG-3/JON-5: every registered feed with its listing count (0 when none)."""
    counts = listings.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return registry.join(counts, "source", "left").select(
        "source", F.col("priority").cast("bigint").alias("priority"), "enabled",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_listings"))


# ------------------------------------------------------------ WIN-5 / AGG-11 gaps

def consecutive_gaps(df: DataFrame, key: str, ts: str, tie: str, bucket_seconds: int = 3600) -> DataFrame:
    """Gap in seconds from each event to the previous event of the same key.

    Order is (ts, tie). Events are partitioned by (key, time bucket), so a key
    holding a large share of all rows is still spread over many tasks; the
    first event of a bucket takes its predecessor from a per-(key, bucket)
    summary (one row per non-empty bucket) looked up in the previous bucket.
    Returns (key, tie, ts, gap_s); the first event of a key has a NULL gap.
    """
    b = F.floor(R.ntz_to_seconds(F.col(ts)) / F.lit(bucket_seconds)).cast("bigint")
    e = df.select(key, ts, tie).withColumn("_b", b)
    w = Window.partitionBy(key, "_b").orderBy(ts, tie)
    inner = e.withColumn("_prev", F.lag(ts).over(w))
    summary = e.groupBy(key, "_b").agg(F.max_by(F.col(ts), F.struct(ts, tie)).alias("_last"))
    ws = Window.partitionBy(key).orderBy("_b")
    carry = summary.select(key, "_b", F.lag("_last").over(ws).alias("_carry"))
    prev = F.coalesce("_prev", "_carry")
    return inner.join(carry, [key, "_b"]).select(key, tie, ts, (F.timestamp_diff("MICROSECOND", prev, F.col(ts)) / F.lit(1e6))
                                                 .alias("gap_s"))


def crawl_delay_audit(gaps: DataFrame, key: str, min_gap_s: float = 60.0) -> DataFrame:
    """WIN-5: per key, gaps shorter than the minimum crawl delay."""
    g = gaps.where(F.col("gap_s").isNotNull())
    return g.groupBy(key).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_gaps"),
        F.count_if(F.col("gap_s") < min_gap_s).cast("bigint").alias("n_short"),
        F.round(F.min("gap_s"), 3).alias("min_gap_s"))


def exact_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, median) without holding a key's values in one task.

    Values are counted per (key, range), a range being 1/64 of an octave; the
    running counts of a key's ranges show which ranges hold the middle ranks, and
    inside those the running counts of distinct values show the values.
    """
    rows = df.select(key, F.col(value).cast("double").alias("_v"))
    rows = rows.withColumn("_r", F.when(F.col("_v") == 0, F.lit(0)).otherwise(
        F.signum("_v") * (F.floor(F.log2(F.abs("_v")) * 64) + (1 << 20))).cast("bigint"))
    up = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    by_range = Window.partitionBy(key).orderBy("_r")
    ranges = rows.groupBy(key, "_r").agg(F.count(F.lit(1)).alias("_n")).select(
        key, "_r", "_n", F.coalesce(F.sum("_n").over(up(by_range)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(key)).alias("_all"))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    holds = ranges.where((F.col("_before") <= high) & (low < F.col("_before") + F.col("_n"))).select(key, "_r", "_before", "_all")
    values = rows.groupBy(key, "_r", "_v").agg(F.count(F.lit(1)).alias("_n")).join(holds, [key, "_r"])
    start = F.col("_before") + F.coalesce(F.sum("_n").over(up(Window.partitionBy(key, "_r").orderBy("_v"))), F.lit(0))
    at = values.withColumn("_start", start)
    is_in = lambda rank: (F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_n"))
    return at.groupBy(key).agg(((F.max(F.when(is_in(low), F.col("_v"))) + F.max(F.when(is_in(high), F.col("_v")))) / 2).alias("median"))


def gap_statistics(gaps: DataFrame, key: str) -> DataFrame:
    """AGG-11: per key, gap count, mean, exact median, sample stddev, min, max (3 decimals)."""
    g = gaps.where(F.col("gap_s").isNotNull())
    stats = g.groupBy(key).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_gaps"),
        F.round(F.avg("gap_s"), 3).alias("mean_s"),
        F.round(F.stddev_samp("gap_s"), 3).alias("stddev_s"),
        F.round(F.min("gap_s"), 3).alias("min_s"),
        F.round(F.max("gap_s"), 3).alias("max_s"))
    return stats.join(exact_median(g, key, "gap_s"), key).select(
        key, "n_gaps", "mean_s", F.round("median", 3).alias("median_s"), "stddev_s", "min_s", "max_s")
