"""Chains of duplicates, deep pages, learned sizes, counters in the write pass, event-time windows and repeats on streams."""

import contextlib
import io
import json
import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from feedlake.operators import dedup as D
from feedlake.operators import normalise as N
from feedlake.operators import ops as O
from feedlake.operators import quality as Q
from feedlake.operators import serving as S
from feedlake.streaming import landing as P


# ------------------------------------------------------------ DED-3

def walk(rows):
    """(order, pair, url) one by one."""
    pairs, urls, kept = set(), set(), []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or "")):
        p, u = r[1] or "", r[2] or ""
        if p not in pairs and u not in urls:
            pairs.add(p)
            urls.add(u)
            kept.append(r)
    return sorted(kept, key=repr)


def deduped(spark, rows, stats=None):
    df = spark.createDataFrame(rows, "o long, p string, u string")
    return sorted((tuple(r) for r in D.greedy_two_key(df, F.col("o"), F.col("p"), F.col("u"), stats=stats).collect()), key=repr)


def test_a_chain_of_ten_thousand_keys_in_few_rounds(spark):
    rows = [(i, f"p{(i + 1) // 2}", f"u{i // 2}") for i in range(10_000)]  # each row shares one key with the one before
    stats = {}
    assert deduped(spark, rows, stats) == sorted(((i, f"p{(i + 1) // 2}", f"u{i // 2}") for i in range(0, 10_000, 2)), key=repr)
    assert stats["rounds"] <= D.PLAIN + 2


def test_chains_with_branches_equal_the_walk(spark, monkeypatch):
    monkeypatch.setattr(D, "PLAIN", 0)
    rng = random.Random(5)
    for n, keys in ((300, 12), (400, 150)):
        rows = [(rng.choice([None, rng.randrange(200)]) if i % 50 == 0 else rng.randrange(10 ** 6), rng.choice([None, f"p{rng.randrange(keys)}"]) if i % 40 == 0 else
                 f"p{rng.randrange(keys)}", f"u{rng.randrange(keys)}") for i in range(n)]
        rows += [(i + 10 ** 7, f"c{(i + 1) // 2}", f"d{i // 2}") for i in range(60)] + [(10 ** 7 + 30, "p1", "d15"), (10 ** 7 + 31, "c16", "u3")]
        assert deduped(spark, rows + rows[:20]) == walk(rows)
    assert deduped(spark, []) == []


# ------------------------------------------------------------ WIN-1

def test_a_deep_page_reads_its_own_ranges_only(spark, scratch):
    n = 200_000
    df = spark.range(n).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("external_id"),
                               F.when(F.col("id") % 1000 != 0, F.timestamp_seconds(F.col("id") * 7919 % 5000).cast("timestamp_ntz")).alias("posted_at"))
    path = os.path.join(scratch, "pages")
    S.store_ranked(df, path, 100)
    rows = [r["external_id"] for r in df.orderBy(*S.newest_first()).collect()]
    for page in (1, 2, 12_345, n // 8, 10 ** 6, -3):
        p = min(max(page, 1), n // 8)
        got = S.stored_page(spark, path, page)
        assert [r["external_id"] for r in got.collect()] == rows[(p - 1) * 8:p * 8] and got.first()["page"] == p
    got = S.stored_page(spark, path, 10 ** 6)
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        got.explain("formatted")
    plan = out.getvalue()
    assert "PartitionFilters: [" in plan and "_range" in plan.split("PartitionFilters: [")[1].split("]")[0]
    S.store_ranked(df.limit(0), path + "0", 4)
    assert S.stored_page(spark, path + "0", 5).count() == 0


# ------------------------------------------------------------ VAL-9

def test_sketches_of_parts_answer_like_the_whole(spark):
    n = 300_000
    sizes = spark.range(n).select((F.col("id") % 2).alias("g"), (F.col("id") * F.col("id") % 100_003).alias("v"), (F.col("id") % 5).alias("part"))
    parts = Q.size_sketches(sizes, ["g", "part"], ["v"])
    got = Q.merge_sketches(parts, ["g"], ["v"]).select("g", *[F.kll_sketch_get_quantile_bigint("v", F.lit(q)).alias(f"q{q}".replace(".", "_")) for q in (0.01, 0.5, 0.99)]).collect()
    for r in got:
        values = sorted(x * x % 100_003 for x in range(n) if x % 2 == r["g"])
        for q, v in zip((0.01, 0.5, 0.99), list(r)[1:]):
            import bisect
            lo, hi = bisect.bisect_left(values, v) / len(values), bisect.bisect_right(values, v) / len(values)
            assert lo - 0.003 <= q <= hi + 0.003


def test_sizes_of_groups_without_history_are_unknown(spark):
    sizes = spark.createDataFrame([("a", 10, 1), ("a", 11, 2), ("a", 12, 3)], "source string, n long, id long")
    learned = Q.size_sketches(sizes, ["source"], ["n"])
    new = spark.createDataFrame([("a", 4, 1), ("a", 11, 2), ("a", 25, 3), ("b", 9, 4), ("a", None, 5)], "source string, n long, id long")
    got = {r["id"]: r["n_status"] for r in Q.learned_range_check(new, learned, ["source"], ["n"]).collect()}
    assert got == {1: "too_few", 2: "ok", 3: "too_many", 4: "unknown", 5: "ok"}


# ------------------------------------------------------------ AGG-5, AGG-10, repeats

def wait_for(listener, done):
    import time

    for _ in range(100):
        if done(listener):
            return
        time.sleep(0.2)


def test_counters_of_a_stream_come_from_the_pass_that_writes(spark, scratch):
    raw = spark.range(40).select(F.col("id").alias("pos"), F.to_json(F.struct(
        F.when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("id"), F.lit("p").alias("position"))).alias("raw"))
    raw.repartition(4).write.parquet(os.path.join(scratch, "raw"))
    stream = spark.readStream.schema("pos long, raw string").option("maxFilesPerTrigger", "1").parquet(os.path.join(scratch, "raw"))
    listener = P.RunMetrics()
    spark.streams.addListener(listener)
    try:
        (P.parse_stream(stream, N.REGISTRY["feed_a"], keep=["pos"]).writeStream.format("parquet").option("path", os.path.join(scratch, "out"))
         .option("checkpointLocation", os.path.join(scratch, "ck")).trigger(availableNow=True).start().awaitTermination(200))
        wait_for(listener, lambda m: m.parsed().get("feed_a", {}).get("received", 0) >= 40)
    finally:
        spark.streams.removeListener(listener)
    out = spark.read.parquet(os.path.join(scratch, "out"))
    assert listener.parsed() == {"feed_a": {"received": 40, "parsed": 34, "skipped": 6}}
    assert out.count() == 34 and set(N.CANONICAL_FIELDS) < set(out.columns)


def test_observed_parsing_has_one_scan(spark, scratch):
    from pyspark.sql import Observation

    spark.range(10).select(F.concat(F.lit('{"id":"'), F.col("id"), F.lit('"}')).alias("raw")).write.parquet(os.path.join(scratch, "raw"))
    df = N.counted(spark.read.parquet(os.path.join(scratch, "raw")), N.REGISTRY["feed_a"], Observation())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "CollectMetrics" in plan


def test_health_windows_of_a_stream_equal_the_batch_report(spark, scratch):
    rng, day0 = random.Random(2), datetime(2024, 3, 1)
    rows = []
    for i in range(120):
        at = day0 + timedelta(minutes=40 * i + rng.randrange(30))
        rows.append((rng.choice("ab"), i, f"k{i}", at, at + timedelta(seconds=rng.randrange(1, 90)), 3, 2, 1, rng.randrange(2), rng.random() < 0.2, rng.choice([None, "e"])))
    last = day0 + timedelta(days=30)
    logs, out, ck = (os.path.join(scratch, x) for x in ("run_logs", "health", "ck"))
    for b in range(12):
        part = rows[10 * b:10 * b + 10]
        rng.shuffle(part)  # out of order within an hour or so
        if b == 3:
            part = part + rows[5:7]  # written again by a replay, late
        spark.createDataFrame(part, P.LOG_SCHEMA).coalesce(1).write.parquet(f"{logs}/batch={b}")
        os.utime(next(os.path.join(f"{logs}/batch={b}", f) for f in os.listdir(f"{logs}/batch={b}") if f.startswith("part")), (1_700_000_000 + b, 1_700_000_000 + b))
    end = [("z", 999, "z", last, last, 0, 0, 0, 0, False, None)]
    spark.createDataFrame(end, P.LOG_SCHEMA).coalesce(1).write.parquet(f"{logs}/batch=99")
    P.start_health(spark, logs, out, ck, delay="12 hours", max_files_per_trigger=1).awaitTermination(300)
    P.start_health(spark, logs, out, ck, delay="12 hours", max_files_per_trigger=1).awaitTermination(300)
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("source", "period", "runs", "success_rate", "block_rate", "drift_count", "avg_latency_s").collect())
    want = sorted(tuple(r) for r in O.source_health(spark.createDataFrame(rows, P.LOG_SCHEMA)).collect())
    assert got == want


def test_bodies_that_land_again_are_applied_once(spark, scratch):
    """Copies within the hour go, also in another micro-batch; another source, another body and a much later copy stay; late ones are counted."""
    landing, out, ck = (os.path.join(scratch, x) for x in ("landing", "out", "ck"))
    base = 1_700_000_000

    def land(source, name, ids, minute):
        os.makedirs(os.path.join(landing, source), exist_ok=True)
        path = os.path.join(landing, source, name)
        with open(path, "w") as f:
            json.dump([{"id": str(i), "position": "p", "company": "c", "url": "u", "epoch": base} for i in ids], f)
        os.utime(path, (base + 60 * minute, base + 60 * minute))
    plan = [("feed_a", "a1", [1, 2], 0), ("feed_a", "a2", [1, 2], 5), ("feed_a", "a3", [3], 10), ("feed_a", "a4", [1, 2], 30), ("feed_a", "b1", [9], 200),
            ("feed_a", "b2", [8], 205), ("feed_a", "c1", [1, 2], 210), ("feed_a", "c2", [9], 215)]
    seen, want = {}, []
    for source, name, ids, minute in plan:  # the rule, one by one
        first = seen.get((source, tuple(ids)))
        if first is None or minute - first > 60:
            seen[source, tuple(ids)] = minute
            want.append(name)
        land(source, f"{name}.json", ids, minute)
    listener = P.RunMetrics()
    spark.streams.addListener(listener)
    run = lambda: (P.first_arrivals(P.landing_stream(spark, landing, 1), "1 hour").writeStream.format("parquet").option("path", out)
                   .option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination(300))
    try:
        run()
        land("feed_a", "late.json", [77], 20)
        run()
        wait_for(listener, lambda m: sum(r["late"] for r in m.rows) >= 1)
    finally:
        spark.streams.removeListener(listener)
    applied = sorted(os.path.basename(r["batch_key"])[:-5] for r in spark.read.parquet(out).select("batch_key").collect())
    assert applied == sorted(want) == ["a1", "a3", "b1", "b2", "c1"]
    assert sum(r["late"] for r in listener.rows) == 1


def test_late_records_lose_by_event_time(spark, scratch):
    from feedlake.operators.snapshots import read

    paths = P.Paths(os.path.join(scratch, "out"))
    body = lambda title, epoch: json.dumps([{"id": "1", "position": title, "company": "c", "url": "u", "epoch": epoch}])
    for n, (title, epoch) in enumerate((("newer", 1_700_000_500), ("late", 1_700_000_200))):
        P.ingest_batch(spark, spark.createDataFrame([("feed_a", f"k{n}", body(title, epoch))], "source string, batch_key string, payload string"), n, paths, event_time="posted_at")
        assert read(spark, paths.listings, P.KEY).first()["title"] == "newer"
