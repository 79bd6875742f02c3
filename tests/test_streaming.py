"""Streaming ingestion: file source + foreachBatch, replays, duplicate files, state."""

import json
import os

from pyspark.sql import functions as F

from feedlake.streaming import landing as P


_CLOCK = [1_700_000_000]


def _land(root, source, name, items):
    """Land one payload file; modification times increase so arrival order is fixed."""
    d = os.path.join(root, source)
    os.makedirs(d, exist_ok=True)
    path = os.path.join(d, name)
    with open(path, "w") as f:
        json.dump(items, f)
    _CLOCK[0] += 10
    os.utime(path, (_CLOCK[0], _CLOCK[0]))


def _rec(i, **extra):
    r = {"id": str(i), "position": f"role {i % 3}", "company": f"co{i % 4}", "url": f"https://x/{i}",
         "epoch": 1700000000 + i}
    r.update(extra)
    return r


def test_stream_ingest_and_replay(spark, scratch):
    landing, out, ck = (os.path.join(scratch, x) for x in ("landing", "out", "ck"))
    _land(landing, "feed_a", "b1.json", [{"legal": "x"}] + [_rec(i) for i in range(5)])
    _land(landing, "feed_a", "b2.json", [_rec(i) for i in range(3, 8)])          # 3 updates, 3 inserts
    _land(landing, "feed_a", "b3.json", [{"id": "9", "position": "p"}])           # missing keys -> dead letter
    q = P.start_ingest(spark, landing, out, ck, max_files_per_trigger=1)
    q.awaitTermination(300)
    logs = spark.read.parquet(os.path.join(out, "run_logs")).orderBy("batch").collect()
    assert [r.success_count for r in logs] == [5, 5, 0]
    assert [r.insert_count for r in logs] == [5, 3, 0]
    assert [r.update_count for r in logs] == [0, 2, 0]
    assert logs[2].block_count == 1 and logs[2].error.startswith("Item 0 missing required keys")
    from feedlake.operators.snapshots import read

    snap = read(spark, os.path.join(out, "listings"), P.KEY)
    assert snap.count() == 8
    assert snap.groupBy("source", "external_id").count().where("count > 1").count() == 0
    dl = spark.read.parquet(os.path.join(out, "dead_letters"))
    assert dl.count() == 1

    # same checkpoint again: nothing new is processed
    q = P.start_ingest(spark, landing, out, ck)
    q.awaitTermination(300)
    assert spark.read.parquet(os.path.join(out, "run_logs")).count() == 3

    # a new file with an already-seen record: update only
    _land(landing, "feed_a", "b4.json", [_rec(0, position="changed")])
    q = P.start_ingest(spark, landing, out, ck)
    q.awaitTermination(300)
    snap = read(spark, os.path.join(out, "listings"), P.KEY)
    assert snap.count() == 8
    assert snap.where(F.col("external_id") == "0").first().title == "changed"


def test_ingest_batch_replay_is_idempotent(spark, scratch):
    paths = P.Paths(os.path.join(scratch, "out"))
    payloads = spark.createDataFrame(
        [("feed_a", "k1", json.dumps([_rec(i) for i in range(4)]))], "source string, batch_key string, payload string")
    P.ingest_batch(spark, payloads, 0, paths)
    P.ingest_batch(spark, payloads, 0, paths)   # replay of the same micro-batch
    from feedlake.operators.snapshots import read

    assert read(spark, paths.listings, P.KEY).count() == 4
    log = spark.read.parquet(paths.run_logs).collect()
    assert len(log) == 1 and log[0].insert_count == 4


def _events(spark, rows):
    return spark.createDataFrame(rows, "user string, ts string, event_id long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_streaming_cooldown_state(spark, scratch):
    src = os.path.join(scratch, "events")
    rows = [("a", "2024-01-01 00:00:00", 1), ("a", "2024-01-01 10:00:00", 2), ("a", "2024-01-02 00:00:00", 3),
            ("b", "2024-01-01 05:00:00", 4)]
    _events(spark, rows).write.parquet(src)
    stream = spark.readStream.schema("user string, ts timestamp_ntz, event_id long").parquet(src)
    root = os.path.join(scratch, "cool")
    P.start_cooldown(stream, root, os.path.join(scratch, "ck"), "user", "ts", "event_id", 86400.0).awaitTermination(300)
    got = {r.event_id: r.counted for r in spark.read.parquet(root + "/blocks").collect()}
    assert got == {1: True, 2: False, 3: True, 4: True}


def test_cooldown_of_unordered_and_late_blocks(spark, scratch):
    """Reversed order within a micro-batch, late blocks in the next, and a replay, against the sequential rule."""
    first = [("k", f"2024-01-01 00:{m:02d}:00", m) for m in (50, 40, 30, 20, 10, 0)]
    second = [("k", "2024-01-01 00:05:00", 100), ("k", "2024-01-01 01:20:00", 101), ("k", "2024-01-01 00:59:00", 102)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        P.fold_cooldown(spark, _events(spark, first), 0, scratch, "user", "ts", "event_id", 1200.0)
        for _ in range(2):
            out = P.fold_cooldown(spark, _events(spark, second), 1, scratch, "user", "ts", "event_id", 1200.0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    counted = {r.event_id for r in spark.read.parquet(scratch + "/blocks").where("counted").collect()}
    assert counted == {0, 20, 40, 101} and out.count() == 3
    state = spark.read.parquet(f"{scratch}/state/batch=1").first()
    assert (state.identity, state.blocks) == ("k", 4)


def test_every_record_is_kept_somewhere(spark, scratch):
    """Two files a trigger, an unknown and a disabled source, an unreadable body, a drifted batch."""
    from dataclasses import replace

    from feedlake.operators.normalise import REGISTRY
    from feedlake.operators.snapshots import read

    paths = P.Paths("file:" + os.path.join(scratch, "out"))
    feeds = {**REGISTRY, "feed_a": replace(REGISTRY["feed_a"], stable_keys=("epoch",))}
    slug = [_rec(i, slug=f"s{i}") for i in range(4)]
    bare = [{k: v for k, v in _rec(i).items() if k != "epoch"} for i in range(20, 26)]
    bad = [_rec(30), {"id": "31"}, *(_rec(i) for i in range(32, 37))]
    cols = "source string, batch_key string, arrived timestamp, payload string"
    from datetime import datetime
    at = [datetime(2024, 1, 1, 0, m) for m in range(10)]
    one = spark.createDataFrame([("feed_a", "/l/b10.json", at[0], json.dumps(slug)),
                                 ("feed_a", "/l/b2.json", at[1], json.dumps([_rec(3, position="newest")]))], cols)
    two = spark.createDataFrame([("feed_a", "d", at[2], json.dumps(bare)), ("feed_a", "e", at[3], json.dumps(bad)),
                                 ("feed_a", "f", at[4], "<html>Access Denied</html>"), ("feed_x", "g", at[5], "[1]"),
                                 ("feed_c", "h", at[6], json.dumps({"data": []})),
                                 ("feed_a", "i", at[7], json.dumps([_rec(9)]))], cols)
    P.ingest_batch(spark, one, 0, paths, feeds)
    log = {r.batch_key: r for r in P.ingest_batch(spark, two, 1, paths, feeds).collect()}
    snap = {r.external_id: r.title for r in read(spark, paths.listings, P.KEY).collect()}
    assert set(snap) == {"0", "1", "2", "3", "9"} and snap["3"] == "newest"  # by arrival, not by name; no slug is no drift
    held = spark.read.parquet(paths.quarantine).where("batch = 1").collect()
    assert sorted(json.loads(r.raw)["id"] for r in held if r.batch_key in "de") == sorted(
        [str(i) for i in range(20, 26)] + [str(i) for i in range(30, 37)])
    assert {r.batch_key: r.raw for r in held if r.batch_key in "fgh"} == {
        "f": "<html>Access Denied</html>", "g": "[1]", "h": '{"data": []}'}
    letters = {(r.source, r.reason.split(":")[0]): list(r.raw_sample) for r in spark.read.parquet(paths.dead_letters).collect()}
    assert set(letters) == {("feed_a", "schema_drift"), ("feed_a", "Item 1 missing required keys"),
                            ("feed_a", "Expected list, got str"), ("feed_x", "Unregistered source"), ("feed_c", "Source disabled")}
    assert len(letters["feed_a", "schema_drift"]) == 3
    assert log["d"].schema_drift and log["i"].insert_count == 1 and log["g"].error == "Unregistered source"


def test_a_read_error_fails_the_batch(spark, scratch):
    import pytest

    paths = P.Paths(os.path.join(scratch, "out"))
    payload = lambda i: spark.createDataFrame([("feed_a", f"k{i}", json.dumps([_rec(i)]))], "source string, batch_key string, payload string")
    P.ingest_batch(spark, payload(1), 0, paths)
    versions = os.path.join(paths.listings, "_versions", f"{0:012d}")
    for f in os.listdir(versions):
        if f.endswith(".json"):
            with open(os.path.join(versions, f), "w") as out:
                out.write(json.dumps({"kind": "base", "bucket": 1, "version": 0, "n": 1, "path": os.path.join(scratch, "nowhere")}))
            os.unlink(os.path.join(versions, f".{f}.crc"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND|nowhere"):
        P.ingest_batch(spark, payload(2), 1, paths)


def test_merge_keeps_fields_that_only_the_target_has(spark):
    from feedlake.operators import upsert as U

    target = spark.createDataFrame([(1, "a", "keep"), (2, "b", "too")], "id long, v string, extra string")
    got = U.merge(target, spark.createDataFrame([(1, "n", 1), (3, "m", 1)], "id long, v string, o long"), ["id"], ["o"])
    assert {r.id: (r.v, r.extra) for r in got.collect()} == {1: ("n", "keep"), 2: ("b", "too"), 3: ("m", None)}


def test_a_body_beyond_the_variant_limit_passes(spark):
    from feedlake.operators import quality as Q

    n = 100_000
    body = "[" + ",".join('{"id":"%d","z":1,"a":"%s"}' % (i, "x" * 1400) for i in range(n)) + "]"
    df = spark.createDataFrame([("feed_a", 1, body)], "source string, batch_id long, payload string")
    m, r = Q.scan_payloads(df)
    assert m.first().payload_type == "list" and m.first().n_items == n
    assert r.where("pos = 5").first().raw.startswith('{"id":"5","z":1,"a":')


def test_run_metrics_listener(spark, scratch):
    import time

    landing, out, ck = (os.path.join(scratch, x) for x in ("landing", "out", "ck"))
    _land(landing, "feed_a", "m1.json", [_rec(i) for i in range(3)])
    _land(landing, "feed_a", "m2.json", [_rec(i) for i in range(3, 5)])
    listener = P.RunMetrics()
    spark.streams.addListener(listener)
    try:
        q = P.start_ingest(spark, landing, out, ck, max_files_per_trigger=1)
        q.awaitTermination(300)
        for _ in range(50):
            if len(listener.rows) >= 2:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    batches = [r for r in listener.rows if r["input_rows"]]
    assert [r["batch"] for r in batches] == [0, 1]
    # each file is one row; the micro-batch is read by several actions, so the count is at least one
    assert all(r["input_rows"] >= 1 for r in batches)


def test_duplicate_files_and_fresh_checkpoint(spark, scratch):
    from feedlake.operators.snapshots import read

    landing, out = os.path.join(scratch, "landing"), os.path.join(scratch, "out")
    items = [_rec(i) for i in range(4)]
    _land(landing, "feed_a", "d1.json", items)
    _land(landing, "feed_a", "d1-copy.json", items)        # the same payload landed twice
    q = P.start_ingest(spark, landing, out, os.path.join(scratch, "ck1"), max_files_per_trigger=1)
    q.awaitTermination(300)
    logs = spark.read.parquet(os.path.join(out, "run_logs")).orderBy("batch").collect()
    assert [(r.insert_count, r.update_count) for r in logs] == [(4, 0), (0, 4)]
    assert read(spark, os.path.join(out, "listings"), P.KEY).count() == 4

    # checkpoint lost: a fresh checkpoint replays every file into the same output
    q = P.start_ingest(spark, landing, out, os.path.join(scratch, "ck2"), max_files_per_trigger=1)
    q.awaitTermination(300)
    snap = read(spark, os.path.join(out, "listings"), P.KEY)
    assert snap.count() == 4
    assert snap.groupBy("external_id").count().where("count > 1").count() == 0
    logs = spark.read.parquet(os.path.join(out, "run_logs")).orderBy("batch").collect()
    assert [(r.insert_count, r.update_count) for r in logs] == [(4, 0), (0, 4)]
