"""Merging landed fetches: envelopes, page-numbered and cursor-paged sequences.

A fetch is an ordered sequence of requests; each landed response is one row.
The sequential stop rules ("stop before a bad response", "stop after the last
page") become a take-while prefix: the first stop of each kind per fetch,
an aggregate of request numbers that combines before the shuffle. Records are
exploded only from the requests that survive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions import json as J


def take_while(requests: DataFrame, fetch: str, seq: str, stop_before: Column, stop_after: Column) -> DataFrame:
    """WIN-3: keep requests up to (not including) the first ``stop_before`` and up
    to (including) the first ``stop_after``, in ``seq`` order per ``fetch``."""
    stops = requests.select(fetch, seq, stop_before.alias("_sb"), stop_after.alias("_sa")).groupBy(fetch).agg(
        F.min(F.when(F.col("_sb"), F.col(seq))).alias("_until"), F.min(F.when(F.col("_sa"), F.col(seq))).alias("_last"))
    return (requests.join(stops, fetch).where((F.col("_until").isNull() | (F.col(seq) < F.col("_until")))
                                              & (F.col("_last").isNull() | (F.col(seq) <= F.col("_last"))))
            .drop("_until", "_last"))


def unwrap_envelope(payload: Column) -> Column:
    """SRC-4: response body -> struct(jobs ARRAY<VARIANT>, cursor STRING).

    Object -> its ``data``; if ``data`` is an object take ``jobs`` and
    ``cursor``; if it is an array take it whole; a bare array body is taken
    whole with no cursor; anything else gives no jobs.
    """
    v = J.parse(payload)
    t = J.kind_of(v)
    data = F.try_variant_get(v, "$.data", "variant")
    dt = J.kind_of(data)
    arr = lambda x: F.try_variant_get(x, "$", "array<variant>")
    jobs = (F.when(t.startswith("ARRAY"), arr(v))
            .when(t.startswith("OBJECT") & dt.startswith("OBJECT"), F.try_variant_get(data, "$.jobs", "array<variant>"))
            .when(t.startswith("OBJECT") & dt.startswith("ARRAY"), arr(data)))
    cursor = F.when(t.startswith("OBJECT") & dt.startswith("OBJECT"), F.try_variant_get(data, "$.cursor", "string"))
    return F.struct(F.coalesce(jobs, F.array().cast("array<variant>")).alias("jobs"), cursor.alias("cursor"))


def cursor_merge(records: DataFrame, fetch: str, seq: str, pos: str, job_id: str, total_jobs: int | None = None) -> DataFrame:
    """SRC-3 (after ``take_while``): first occurrence per non-empty job id across the
    fetch's batches, records without an id kept as they are; the records come with
    all their columns. A request's own ``total_jobs`` keeps that many, in arrival order.

    First occurrence is one keyed aggregation that carries the record, map-side
    combined: the records are computed once, and a popular id is reduced before
    the shuffle.
    """
    has_id = F.coalesce(F.length(F.col(job_id)) > 0, F.lit(False))
    key = F.when(has_id, F.col(job_id)).otherwise(F.concat_ws(":", F.lit("\u0000"), F.col(seq), F.col(pos)))
    first = records.groupBy(F.col(fetch).alias("_fetch"), key.alias("_key")).agg(
        F.min_by(F.struct(*records.columns), F.struct(seq, pos)).alias("_first"))
    merged = first.select("_first.*")
    if total_jobs is None:
        return merged
    w = Window.partitionBy(fetch).orderBy(seq, pos)
    return merged.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= total_jobs).drop("_rn")


def fetch_stats(requests: DataFrame, kept: DataFrame, fetch: str, seq: str, total_jobs: int | None = None) -> DataFrame:
    """AGG-6: per request made: received, new (kept) records, running total, has cursor.

    ``requests`` are the take-while survivors with ``received`` and
    ``has_cursor``; with ``total_jobs`` a request is only made while the running
    total is below it. The running total is a window over one row per request.
    """
    new = kept.groupBy(fetch, seq).agg(F.count(F.lit(1)).alias("new_added"))
    j = requests.join(new, [fetch, seq], "left").withColumn("new_added", F.coalesce("new_added", F.lit(0)))
    w = Window.partitionBy(fetch).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = j.select(fetch, seq, F.col("received").cast("bigint"), F.col("new_added").cast("bigint"),
                   F.sum("new_added").over(w).cast("bigint").alias("total_accumulated"), "has_cursor")
    return out if total_jobs is None else out.where(F.col("total_accumulated") - F.col("new_added") < total_jobs)
