"""The stored snapshot: deltas merged on read, compaction, buckets that split, replays, late records."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from feedlake.operators import snapshots as S
from feedlake.operators import upsert as U

SCHEMA = "k long, s string, v long, at long, seq long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def folded(batches, by_time=False):
    """The snapshot by walking all rows one by one."""
    held = {}
    for rows in batches:
        for r in sorted(rows, key=lambda r: r[4]):
            old = held.get(r[:2])
            if not (by_time and old is not None and old[3] is not None and (r[3] is None or r[3] < old[3])):
                held[r[:2]] = r
    return sorted(r[:4] for r in held.values())


def stored(df):
    return sorted(tuple(r) for r in df.select("k", "s", "v", "at").collect())


def batches(seed, n=6):
    rng, seq = random.Random(seed), iter(range(10 ** 6))
    out = []
    for b in range(n):
        keys = [rng.randrange(0, 60 + 40 * b) for _ in range(rng.choice([3, 40, 150]))] + [7] * 30
        out.append([(k, "ab"[k % 2], rng.randrange(1000), rng.choice([None, *range(20)]), next(seq)) for k in keys])
    return out


@pytest.mark.parametrize("by_time", [False, True])
def test_every_version_equals_a_full_merge(spark, scratch, by_time):
    policy = S.Policy(limit=40, least=10, deltas=4)
    parts, root = batches(3), os.path.join(scratch, "t")
    for n, rows in enumerate(parts):
        held = S.upsert(spark, frame(spark, rows), root, n, ["k", "s"], ["seq"], event_time="at" if by_time else None, policy=policy)
        assert stored(S.read(spark, root, ["k", "s"])) == folded(parts[:n + 1], by_time)
        assert len(held.deltas) <= 5
    assert len(held.buckets) > 4 and max(b.rows for b in held.buckets) <= 2 * policy.limit
    assert sum(2.0 ** -b.depth for b in held.buckets) == 1  # the prefixes part the space
    files = [f"{b.path}/{f}" for b in held.buckets if b.path for f in os.listdir(b.path) if f.endswith(".parquet")]
    assert len(files) == sum(1 for b in held.buckets if b.path)
    # a replay of the newest version, then of an older one, then all that follow
    for n in (5, 4, 5):
        S.upsert(spark, frame(spark, parts[n]), root, n, ["k", "s"], ["seq"], event_time="at" if by_time else None, policy=policy)
        assert stored(S.read(spark, root, ["k", "s"])) == folded(parts[:n + 1], by_time)
    assert len(os.listdir(os.path.join(root, "_versions"))) == S.KEEP


def test_a_batch_writes_its_own_rows_and_reads_its_own_buckets(spark, scratch):
    policy = S.Policy(limit=100, least=50)
    root = os.path.join(scratch, "t")
    S.upsert(spark, frame(spark, [(i, "x", i, 0, i) for i in range(2000)]), root, 0, ["k", "s"], ["seq"], policy=policy)
    before = {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}
    batch = frame(spark, [(5, "x", -1, 0, 1)])
    assert S.read(spark, root, ["k", "s"], of=batch).count() < 200
    S.upsert(spark, batch, root, 1, ["k", "s"], ["seq"], policy=policy)
    new = {os.path.join(d, f) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")} - before
    assert sum(spark.read.parquet(f).count() for f in new) == 1
    snap = S.read(spark, root, ["k", "s"])
    assert snap.count() == 2000 and snap.where("v = -1").count() == 1


def test_old_files_go_and_fields_that_only_the_snapshot_has_stay(spark, scratch):
    policy = S.Policy(least=1)
    root = os.path.join(scratch, "t")
    S.upsert(spark, frame(spark, [(1, "x", 1, 0, 1), (2, "x", 2, 0, 2), (None, None, 5, 0, 3)]), root, 0, ["k", "s"], ["seq"], policy=policy)
    for n in range(1, 7):
        S.upsert(spark, frame(spark, [(1, "x", 10 * n, 0, 1), (None, None, n, 0, 2)]).drop("at"), root, n, ["k", "s"], ["seq"], policy=policy)
        assert stored(S.read(spark, root, ["k", "s"]).na.fill(-1).na.fill("")) == [(-1, "", n, 0), (1, "x", 10 * n, 0), (2, "x", 2, 0)]
    assert sorted(os.listdir(os.path.join(root, "_versions"))) == [f"{v:012d}" for v in (4, 5, 6)]
    assert not os.path.exists(os.path.join(root, "base", f"v={1:012d}", "_bucket=1"))
    assert S.read(spark, os.path.join(scratch, "none"), ["k"]) is None


def shuffles(df):
    return re.findall(r"\bExchange \w+|SortMergeJoin", df._jdf.queryExecution().executedPlan().toString())


def test_a_merge_shuffles_its_rows_once(spark, scratch):
    late = S.Policy(limit=40, least=10 ** 6, deltas=10 ** 6)
    parts, root, keys = batches(5, 4), os.path.join(scratch, "t"), ["k", "s"]
    parts[1] += [(None, "a", 1, 0, 10 ** 6), (1, None, 2, 0, 10 ** 6), (None, None, 3, 0, 10 ** 6)]
    parts[3] += [(None, None, 4, 0, 10 ** 6)]
    for n, rows in enumerate(parts):
        held = S.upsert(spark, frame(spark, rows), root, n, keys, ["seq"], policy=late if n else S.Policy(limit=20, least=1))
    assert len(held.deltas) == 3 and len(held.buckets) > 1  # a base and three deltas wait to be merged
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # as in a table of any size: the bucket of a row needs no shuffle, a merge one, by key or by bucket
        assert shuffles(S.placed(spark, frame(spark, parts[1]).select(F.xxhash64(*keys).alias(S.HASH)), held)) == []
        read = S.read(spark, root, keys)
        assert shuffles(read) == ["Exchange hashpartitioning"]
        dealt = S._dealt(spark, S._rows(spark, held, None), S.Manifest((S.Bucket(2), S.Bucket(3))), 2, keys)
        assert shuffles(dealt) == ["Exchange hashpartitioning"]
        plan = dealt._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"\bSort \[", plan)) == 1
        by_null = lambda rows: sorted(rows, key=repr)
        held_by_walk = {r[:2]: r[:4] for rows in parts for r in sorted(rows, key=lambda r: r[4])}
        assert by_null(tuple(r) for r in read.select("k", "s", "v", "at").collect()) == by_null(held_by_walk.values())
        assert by_null(tuple(r) for r in dealt.select("k", "s", "v", "at").collect()) == by_null(held_by_walk.values())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_hot_key_is_spread_over_the_tasks(spark):
    rows = spark.range(20_000).select((F.col("id") % 3).alias("zero"), F.lit(7).alias("k"), (F.col("id") * 17 % 20_011).alias("seq"), F.col("id").alias("v"))
    got = U.latest_per_key(rows, ["k"], ["seq"])
    best = max((i * 17 % 20_011, i) for i in range(20_000))
    assert [(r["seq"], r["v"]) for r in got.collect()] == [best]
    plan = got._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert any("seq" in line for line in dealt) or "BroadcastHashJoin" in plan
