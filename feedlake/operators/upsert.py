"""Idempotent keyed upsert of a batch into a snapshot table, and its counters.

Here are the merge of two tables and its counters; ``snapshots`` keeps a stored
snapshot, batch by batch.

Scale notes: the newest order of a key is found by an aggregation of keys and
order alone, which combines map-side. The winners' full rows are picked by a join
on keys and order together, so the rows of a hot key spread over all tasks; only
rows that are equal in both meet again. After that both join sides hold unique
keys, so the anti join has no skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``left`` joined with ``right`` on keys of which nulls are equal, without the right keys."""
    own = {k: f"_right_{k}" for k in keys}
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in own.items()]
    return left.join(right.withColumnsRenamed(own), on, how).drop(*own.values())


def latest_per_key(batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """WIN-7 / UPS-1: last write wins per key in arrival order; one row of those equal in key and ``order``. Null is a key."""
    newest = F.max(order[0]).alias("_last") if len(order) == 1 else F.max(F.struct(*order)).alias("_last")
    last = batch.groupBy(*keys).agg(newest)
    last = last.select(*keys, *([F.col("_last").alias(order[0])] if len(order) == 1 else [F.col("_last")[c].alias(c) for c in order if c not in keys]))
    on = list(dict.fromkeys(order + keys))  # the order first: it tells rows apart at once when they are sorted
    return joined(batch, last, on, "left_semi").dropDuplicates(keys)


def only_newer(rows: DataFrame, target: DataFrame, keys: list[str], event_time: str) -> DataFrame:
    """The rows that may replace the target's: those of keys it has not, and those that are no older than its row by ``event_time``.

    A row without event time is older than any with one, and replaces one without.
    """
    theirs = target.select(*keys, F.col(event_time).alias("_theirs"), F.lit(True).alias("_held"))
    own = joined(rows, theirs, keys, "left")
    older = F.col("_held") & F.col("_theirs").isNotNull() & (F.col(event_time).isNull() | (F.col(event_time) < F.col("_theirs")))
    return own.where(~F.coalesce(older, F.lit(False))).select(*rows.columns)


def stamped(order: list[str], event_time: str | None) -> list[str]:
    """The order in which rows of a key win: by event time first where one is given."""
    return ([event_time] if event_time else []) + order


def merge(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str],
          ingested_at: Column | None = None, event_time: str | None = None) -> DataFrame:
    """UPS-1/UPS-2: the snapshot after upserting ``batch`` into ``target``.

    Every field that the batch has is replaced on a matched key; fields that
    only the target has survive. ``ingested_at`` is stamped on written rows.
    With ``event_time`` the newest row by it wins, and one that is older than
    the target's changes nothing.
    """
    new = latest_per_key(batch, keys, stamped(order, event_time))
    new = only_newer(new, target, keys, event_time) if event_time else new
    if ingested_at is not None:
        new = new.withColumn("ingested_at", ingested_at)
    extra = [c for c in target.columns if c not in new.columns]
    kept = joined(target, new.select(*keys), keys, "left_anti")
    if extra:
        new = joined(new, target.select(*keys, *extra), keys, "left")
    return kept.unionByName(new, allowMissingColumns=True)


def upsert_counts(target: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """UPS-3: success = records written, insert = distinct new keys, update = the rest.

    One keyed aggregation of the batch (map-side combined), a join with the
    target's keys (both sides shuffled on the same keys), one global count.
    """
    per_key = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    old = target.select(*keys).distinct().withColumn("_old", F.lit(True))
    flagged = per_key.join(old, keys, "left")
    return flagged.agg(F.sum("_c").alias("s"), F.count_if(F.col("_old").isNull()).alias("i")).select(
        F.coalesce(F.col("s"), F.lit(0)).cast("bigint").alias("success_count"),
        F.col("i").cast("bigint").alias("insert_count"),
        (F.coalesce(F.col("s"), F.lit(0)) - F.col("i")).cast("bigint").alias("update_count"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """UPS-5: keys held by more than one row (empty for a valid snapshot)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
