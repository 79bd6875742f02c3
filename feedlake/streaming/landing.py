"""Structured Streaming ingestion: landed payload files -> gate -> normalise ->
drift -> upsert -> run log, one micro-batch per trigger (STR-1..4, STR-8).

Landing layout: ``<landing>/<source_id>/<any name>.json``, one JSON payload
per file (a response body). The file path is the batch identity; the body of a
second attempt lands as ``<any name>.retry.json`` and belongs to the batch of
``<any name>.json``. The stream is a file source (``wholetext``), so each
micro-batch picks up new files only and the checkpoint records which files were
processed.

Every output of a micro-batch is keyed by the micro-batch id: run logs,
dead letters, quarantined records and snapshot fields are written to ``.../batch=<id>`` with
overwrite, and the listing snapshot is published as version ``<id>``. A
replayed micro-batch (after a failure before the commit) therefore rewrites
the same files, and the upsert of the same records is idempotent.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from feedlake.functions import rules as R
from feedlake.operators import cooldown as CD
from feedlake.operators import normalise as N
from feedlake.operators import ops as O
from feedlake.operators import quality as Q
from feedlake.operators import snapshots as S
from feedlake.operators.normalise import REGISTRY, FeedSpec

KEY = ["source", "external_id"]
KEY_OF_BATCH = Q.KEY
LOG_SCHEMA = ("source string, batch_id long, batch_key string, started_at timestamp_ntz, finished_at timestamp_ntz, success_count long, "
              "insert_count long, update_count long, block_count long, schema_drift boolean, error string")


#: The end of the path of a second attempt's body.
RETRY = r"\.retry(\.[^./]+)$"
FAILED_AGAIN, NOT_NEEDED = "validation_failed_after_fallback", "Attempt not needed"


@dataclass
class Paths:
    root: str

    @property
    def listings(self) -> str:
        return f"{self.root}/listings"

    @property
    def run_logs(self) -> str:
        return f"{self.root}/run_logs"

    @property
    def dead_letters(self) -> str:
        return f"{self.root}/dead_letters"

    @property
    def quarantine(self) -> str:
        return f"{self.root}/quarantine"

    @property
    def snapshots(self) -> str:
        return f"{self.root}/schema_snapshots"


def landing_stream(spark: SparkSession, landing: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """STR-1: file-source stream of landed payloads: (source, batch_key, attempt, arrived, payload)."""
    r = spark.readStream.format("text").option("wholetext", "true")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = r.load(f"{landing.rstrip('/')}/*/")
    path = F.col("_metadata.file_path")
    return df.select(F.element_at(F.split(path, "/"), -2).alias("source"), F.regexp_replace(path, RETRY, "$1").alias("batch_key"),
                     F.when(path.rlike(RETRY), 2).otherwise(1).alias("attempt"),
                     F.col("_metadata.file_modification_time").alias("arrived"), F.col("value").alias("payload"))


def first_arrivals(landed: DataFrame, delay: str) -> DataFrame:
    """Of equal payloads of a source (and attempt) that land within ``delay`` of each other the first; state is kept as long, no longer.

    For feeds that land a body more than once. A body that comes again later is a
    new one as soon as a micro-batch has closed with the watermark behind the
    first. Bodies that arrive later than the watermark, ``delay``
    behind the newest arrival, cannot be judged and do not pass; ``RunMetrics``
    counts them as ``late``.
    """
    same = ["source", "_digest", *(c for c in ["attempt"] if c in landed.columns)]
    return (landed.withColumn("_digest", F.sha2("payload", 256)).withWatermark("arrived", delay)
            .dropDuplicatesWithinWatermark(same).drop("_digest"))


def _latest_snapshot_fields(spark: SparkSession, paths: Paths, before: int) -> DataFrame:
    """Newest saved field set per source from micro-batches before ``before``
    (a replayed batch never reads what it is about to rewrite)."""
    if not S.exists(spark, paths.snapshots):
        return spark.createDataFrame([], "source string, fields array<string>")
    snaps = spark.read.parquet(paths.snapshots).where(F.col("batch") < before)
    return Q.latest_snapshot(snaps.withColumnRenamed("batch", "batch_id"), F.lit(None)).select("source", "fields")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def ingest_batch(spark: SparkSession, payloads: DataFrame, batch: int, paths: Paths,
                 feeds: dict[str, FeedSpec] | None = None, now=None, event_time: str | None = None) -> DataFrame:
    """STR-2: one cycle over the payloads of a micro-batch; returns its run log.

    ``payloads``: (source, batch_key, payload[, arrived][, attempt]); each payload
    is one attempt (1, if not given, or 2) at one batch of one feed (``source`` =
    feed id), a flat array or, where the feed's spec says so, an envelope. Batches
    apply in order of arrival, then key.

    VAL-8: a batch is taken from its first attempt that passes. A failed first
    attempt counts one block and has a dead letter, recovered or not; a failed
    second one has none and the run's error is ``validation_failed_after_fallback``.
    A second attempt whose first one passed beside it is quarantined as not needed;
    one that comes in a later micro-batch than its first is judged alone. The
    reason of a text response says if it looks like a block page (VAL-5).

    Nothing is dropped: a record ends in the listings (or is superseded there)
    or in the quarantine table, with the reason of its batch. Bodies without
    readable records, of unknown or of disabled sources are quarantined whole.
    Every rejected batch, a drifted one too, has a dead letter with a sample.

    Drift compares the fields that a feed's spec declares stable (its required
    keys and ``stable_keys``) with the last good snapshot, by a vote of the
    whole batch; other keys may come and go.

    With ``event_time`` (``posted_at``) a record that is older than the stored one does not replace it.
    """
    feeds = feeds or REGISTRY
    now = now if now is not None else F.current_timestamp().cast("timestamp_ntz")
    if "arrived" not in payloads.columns:
        payloads = payloads.withColumn("arrived", F.lit(None).cast("timestamp"))
    if "attempt" not in payloads.columns:
        payloads = payloads.withColumn("attempt", F.lit(1))
    number = F.when(F.col("attempt").isin(1, 2), F.col("attempt").cast("int")).otherwise(F.raise_error(F.lit("an attempt is 1 or 2")).cast("int"))
    p = payloads.withColumns({"batch_id": F.xxhash64("source", "batch_key"), "attempt": number})
    ids = p.groupBy("source", "batch_id", "batch_key").agg(F.max("arrived").alias("arrived"))
    each = [*KEY_OF_BATCH, "attempt"]
    active = {k: v for k, v in feeds.items() if v.enabled}
    scans = {src: Q.scan_payloads(p.where(F.col("source") == src), key_field=spec.extra.get("scan_key"),
                                  keep=["batch_key", "arrived", "attempt"], unwrap=spec.extra.get("envelope", False), pages=True)
             for src, spec in active.items()}
    records = _union([r for _, r in scans.values()]).persist()
    unknown = p.where(~F.col("source").isin(*active)).select(
        *each, F.lit(False).alias("ok"),
        F.when(F.col("source").isin(*feeds), F.lit("Source disabled")).otherwise(F.lit("Unregistered source")).alias("reason"),
        F.lit(None).cast("array<string>").alias("missing"), F.lit(0).cast("bigint").alias("n_items"))
    of = lambda src: records.where(F.col("source") == src)
    judged = _union([unknown, *(Q.batch_verdicts(m, of(src), list(active[src].required_keys), active[src].min_items, key=each)
                                for src, (m, _) in scans.items())]).persist()
    first_failed = F.coalesce(F.bool_or(~F.col("ok") & (F.col("attempt") == 1)), F.lit(False)).alias("blocked")
    verdicts = Q.resolve_attempts(judged).join(judged.groupBy(*KEY_OF_BATCH).agg(first_failed, F.max("attempt").alias("last")), KEY_OF_BATCH).select(
        *KEY_OF_BATCH, F.col("accepted_attempt").cast("int").alias("attempt"), F.col("accepted_attempt").isNotNull().alias("ok"), "blocked",
        F.when(F.col("last") == 2, F.lit(FAILED_AGAIN)).otherwise(F.col("first_reason")).alias("reason")).persist()
    taken = verdicts.where("ok").select(*each)
    passed = records.join(taken, each, "left_semi")
    normalised = _union([spec.normalise(passed.where(F.col("source") == src), keep=["batch_id", "batch_key", "arrived", "pos"])
                         for src, spec in active.items()]).persist()

    # drift of the declared fields against the last good snapshot (VAL-6, STR-4)
    docs = Q.record_keys(normalised)
    declared = _union([spark.createDataFrame([(src, k) for k in {*spec.required_keys, *spec.stable_keys}], "source string, field string")
                       for src, spec in active.items()])
    known = (_latest_snapshot_fields(spark, paths, batch).select("source", F.explode("fields").alias("field"))
             .join(declared, ["source", "field"], "left_semi").groupBy("source").agg(F.collect_list("field").alias("fields")))
    drifted = (Q.schema_drift(docs, known).groupBy(*KEY_OF_BATCH)
               .agg(F.sort_array(F.collect_list("field")).alias("missing")).persist())
    moved = drifted.join(taken, KEY_OF_BATCH).select(*each, F.lit(False).alias("ok"), F.lit("schema_drift").alias("reason"), "missing")
    failed = judged.where(~F.col("ok")).select(*each, "ok", "reason", "missing")
    spare = judged.where("ok").join(taken, each, "left_anti").select(*each, F.lit(False).alias("ok"), F.lit(NOT_NEEDED).alias("reason"), "missing")
    rejected = _union([failed, spare, moved]).persist()
    good = normalised.join(drifted.select(*KEY_OF_BATCH), KEY_OF_BATCH, "left_anti")

    # all rejected records and unreadable bodies, and a dead letter with a sample for each failed first attempt and each drifted batch
    body = (p.select(*each, "batch_key", F.col("payload").alias("raw"))
            .join(rejected.select(*each, "reason"), each)
            .join(records.select(*each).distinct(), each, "left_anti").withColumn("pos", F.lit(None).cast("bigint")))
    held = records.join(rejected.select(*each, "reason"), each).select(*each, "batch_key", "pos", "raw", "reason")
    held = held.unionByName(body.select(*held.columns)).withColumn("recorded_at", now)
    held.write.mode("overwrite").parquet(f"{paths.quarantine}/batch={batch}")
    sample = held.select(*each, F.coalesce("pos", F.lit(0).cast("bigint")).alias("pos"), "raw", "reason")
    blocked = Q.dead_letters(sample.where("attempt = 1"), failed.where("attempt = 1"), now)
    changed = Q.dead_letters(sample.where("reason = 'schema_drift'"), moved, now)
    blocked.unionByName(changed).write.mode("overwrite").parquet(f"{paths.dead_letters}/batch={batch}")

    # upsert into the listing snapshot as version `batch`: the batch's own rows, merged on read (UPS-1, STR-3)
    rows = good.drop("batch_id")
    target = S.read(spark, paths.listings, KEY, before=batch, of=rows)
    first = good.groupBy(*KEY).agg(F.min(F.struct("arrived", "batch_key", "batch_id")).alias("_f"))
    first = first if target is None else first.join(target.select(*KEY), KEY, "left_anti")
    new_keys = first.groupBy(F.col("_f.batch_id").alias("batch_id")).agg(F.count(F.lit(1)).alias("insert_count"))
    written = good.groupBy(*KEY_OF_BATCH).agg(F.count(F.lit(1)).alias("success_count"))
    order = ["arrived", "batch_key", "pos"]
    S.upsert(spark, rows, paths.listings, batch, KEY, order, ingested_at=now, event_time=event_time, transient=order)

    # schema snapshot: the newest passing, drift-free batch's fields per source (SNK-3)
    fields = Q.snapshot_fields(docs.join(drifted.select(*KEY_OF_BATCH), KEY_OF_BATCH, "left_anti")).join(ids, KEY_OF_BATCH)
    snap = fields.groupBy("source").agg(F.max_by("fields", F.struct("arrived", "batch_key")).alias("fields"))
    snap.withColumn("updated_at", now).write.mode("overwrite").parquet(f"{paths.snapshots}/batch={batch}")

    # run log (AGG-1, SNK-1, STR-8)
    succ = F.coalesce("success_count", F.lit(0))
    ins = F.coalesce("insert_count", F.lit(0))
    log = (verdicts.select(*KEY_OF_BATCH, "ok", "blocked", "reason").join(ids, KEY_OF_BATCH)
           .join(drifted.select(*KEY_OF_BATCH, F.lit(True).alias("_drift")), KEY_OF_BATCH, "left")
           .join(written, KEY_OF_BATCH, "left").join(new_keys, "batch_id", "left")
           .select("source", "batch_id", "batch_key", now.alias("started_at"), now.alias("finished_at"),
                   succ.cast("bigint").alias("success_count"), ins.cast("bigint").alias("insert_count"),
                   (succ - ins).cast("bigint").alias("update_count"),
                   F.col("blocked").cast("bigint").alias("block_count"),
                   F.coalesce("_drift", F.lit(False)).alias("schema_drift"),
                   F.when(~F.col("ok"), F.col("reason")).when(F.col("_drift"), F.lit("schema_drift"))
                   .alias("error")))
    log.write.mode("overwrite").parquet(f"{paths.run_logs}/batch={batch}")
    for df in (records, judged, verdicts, normalised, drifted, rejected):
        df.unpersist()
    return spark.read.parquet(f"{paths.run_logs}/batch={batch}").withColumn("batch", F.lit(batch).cast("bigint"))


def start_ingest(spark: SparkSession, landing: str, out_root: str, checkpoint: str, trigger: dict | None = None,
                 max_files_per_trigger: int | None = None, repeats_within: str | None = None, event_time: str | None = None):
    """STR-1/STR-3: start the recurring ingestion (``trigger`` e.g.
    ``{"processingTime": "300 seconds"}``; default ``{"availableNow": True}``).

    With ``repeats_within`` (e.g. ``"1 hour"``) a body that lands again within that time is applied once (see
    ``first_arrivals``); with ``event_time`` (``posted_at``) records older than the stored ones change nothing.
    """
    paths = Paths(out_root.rstrip("/"))
    stream = landing_stream(spark, landing, max_files_per_trigger)
    if repeats_within:
        stream = first_arrivals(stream, repeats_within)

    def each(df: DataFrame, batch_id: int) -> None:
        df = df.persist() if repeats_within else df  # the state is read and written once
        if not (repeats_within and df.isEmpty()):  # else only the watermark moved
            ingest_batch(df.sparkSession, df, int(batch_id), paths, event_time=event_time)
        df.unpersist()

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


class RunMetrics(StreamingQueryListener):
    """STR-8: the last ``keep`` micro-batches' progress (id, input rows, duration, late rows, observed counters) on the driver."""

    def __init__(self, keep: int = 1000):
        self.rows: deque[dict] = deque(maxlen=keep)

    def onQueryStarted(self, event):  # noqa: N802
        pass

    def onQueryProgress(self, event):  # noqa: N802
        p = event.progress
        self.rows.append({"batch": p.batchId, "input_rows": p.numInputRows,
                          "duration_ms": (p.durationMs or {}).get("triggerExecution"),
                          "late": sum(s.numRowsDroppedByWatermark for s in p.stateOperators),
                          "observed": {k: r.asDict() for k, r in (p.observedMetrics or {}).items()}})

    def parsed(self) -> dict[str, dict[str, int]]:
        """AGG-5 of the micro-batches so far: received, parsed and skipped records by source, from ``parse_stream``'s counters."""
        out: dict[str, dict[str, int]] = {}
        for r in self.rows:
            for name, counts in r["observed"].items():
                if name.startswith(PARSE):
                    own = out.setdefault(name.removeprefix(PARSE), {"received": 0, "parsed": 0, "skipped": 0})
                    for k in own:
                        own[k] += counts[k]
        return out

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        pass


# ------------------------------------------------------------ parsing and health on streams (AGG-5, AGG-10)

#: Prefix of the names under which ``parse_stream`` observes a source's counters.
PARSE = "parse."


def parse_stream(records: DataFrame, spec: FeedSpec, raw_col: str = "raw", keep: list[str] | None = None) -> DataFrame:
    """Normalised records of a stream of raw ones; received, parsed and skipped are counted in the pass that writes them."""
    return N.counted(records, spec, PARSE + spec.source_id, raw_col, keep)


def health_stream(logs: DataFrame, period: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """AGG-10 on a stream of run logs: ``source_health`` by event-time windows, each given out once the watermark has passed it.

    A run log that is written again by a replayed micro-batch counts once.
    """
    at = F.timestamp_micros(F.timestamp_diff("MICROSECOND", R.epoch_ntz(), F.col("started_at")))  # zone-less times as UTC
    once = logs.withColumn("_at", at).withWatermark("_at", delay).dropDuplicatesWithinWatermark(["source", "batch_id"])
    start = F.timestamp_add("MICROSECOND", F.unix_micros(F.col("_w.start")), R.epoch_ntz())
    return (once.groupBy("source", F.window("_at", period).alias("_w")).agg(*O.health_metrics())
            .select("source", start.alias("period"), "runs", "success_rate", "block_rate", "drift_count", "avg_latency_s"))


def start_health(spark: SparkSession, run_logs: str, out: str, checkpoint: str, period: str = "1 day", delay: str = "1 hour",
                 trigger: dict | None = None, max_files_per_trigger: int | None = None):
    """AGG-10 over the run logs that ``start_ingest`` writes, as files of closed windows."""
    r = spark.readStream.schema(LOG_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    w = health_stream(r.parquet(f"{run_logs.rstrip('/')}/batch=*"), period, delay).writeStream.outputMode("append").format("parquet")
    return w.option("path", out).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


# ------------------------------------------------------------ streaming cooldown (STR-5)

def fold_cooldown(spark: SparkSession, events: DataFrame, batch: int, root: str, identity: str, ts: str, eid: str,
                  delta_s: float) -> DataFrame:
    """STR-5 for one micro-batch: every block (identity, event_id, us, counted), by the batch operator.

    Blocks within the cooldown that earlier micro-batches left, late ones too,
    do not count; the chain of the others starts at each identity's first. The
    state (identity, cooldown_until_us, blocks) is written per micro-batch and
    read from the one before, so a replay rewrites the same files.
    """
    d = int(delta_s * 1_000_000)
    rows = events.select(F.col(identity).cast("string").alias("identity"), F.col(ts).alias("ts"), F.col(eid).alias("event_id"),
                         F.timestamp_diff("MICROSECOND", R.epoch_ntz(), F.col(ts)).alias("us"))
    before = f"{root}/state/batch={batch - 1}"
    state = (spark.read.parquet(before) if S.exists(spark, before)
             else spark.createDataFrame([], "identity string, cooldown_until_us long, blocks long"))
    free = rows.join(state, "identity", "left").where(F.coalesce(F.col("us") >= F.col("cooldown_until_us"), F.lit(True)))
    chained = CD.chain(free.select("identity", "ts", "event_id"), "identity", "ts", "event_id", delta_s)
    counted = chained.select("identity", "event_id", F.lit(True).alias("_counted"))
    out = rows.join(counted, ["identity", "event_id"], "left").select(
        "identity", "event_id", "us", F.coalesce("_counted", F.lit(False)).alias("counted"))
    out.write.mode("overwrite").parquet(f"{root}/blocks/batch={batch}")
    new = spark.read.parquet(f"{root}/blocks/batch={batch}").where("counted").groupBy("identity").agg(
        (F.max("us") + d).alias("_until"), F.count(F.lit(1)).alias("_n"))
    (state.join(new, "identity", "full").select(
        "identity", F.coalesce("_until", "cooldown_until_us").alias("cooldown_until_us"),
        (F.coalesce("blocks", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("blocks"))
     .write.mode("overwrite").parquet(f"{root}/state/batch={batch}"))
    return spark.read.parquet(f"{root}/blocks/batch={batch}")


def start_cooldown(events: DataFrame, root: str, checkpoint: str, identity: str, ts: str, eid: str, delta_s: float,
                   trigger: dict | None = None):
    """STR-5 on a stream: ``fold_cooldown`` of each micro-batch."""
    def each(df: DataFrame, batch_id: int) -> None:
        fold_cooldown(df.sparkSession, df, int(batch_id), root.rstrip("/"), identity, ts, eid, delta_s)

    w = events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()
