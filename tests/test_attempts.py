"""The cycle's second attempt (VAL-8) and its block-page finding (VAL-5), against the sequential rule."""

import json
import os

import pytest

from feedlake.operators.snapshots import read
from feedlake.streaming import landing as P

COLS = "source string, batch_key string, attempt int, payload string"
PAGE = "<html><body>Access Denied</body></html>"


def rec(i, **extra):
    return {"id": str(i), "position": f"role {i}", "company": "co", "url": f"https://x/{i}", "epoch": 1700000000 + i, **extra}


def body(*ids):
    return json.dumps([rec(i) for i in ids])


BAD = json.dumps([rec(50), {"id": "51"}])

#: batch: bodies of its attempts, accepted ids, error, blocks, dead letters
CASES = {
    "passes": ([body(1, 2)], {"1", "2"}, None, 0, 0),
    "passes-twice": ([body(3), body(3, 4)], {"3"}, None, 0, 0),
    "recovers-from-page": ([PAGE, body(5, 6)], {"5", "6"}, None, 1, 1),
    "recovers-from-keys": ([BAD, body(7)], {"7"}, None, 1, 1),
    "fails-twice": ([PAGE, BAD], set(), P.FAILED_AGAIN, 1, 1),
    "fails-once": ([BAD], set(), "Item 1 missing required keys", 1, 1),
    "late": ([None, body(8)], {"8"}, None, 0, 0),
    "late-and-bad": ([None, PAGE], set(), P.FAILED_AGAIN, 0, 0),
}


def test_attempts_equal_the_sequential_rule(spark, scratch):
    paths = P.Paths(os.path.join(scratch, "out"))
    rows = [("feed_a", k, n + 1, b) for k, (bodies, *_) in CASES.items() for n, b in enumerate(bodies) if b is not None]
    log = {r.batch_key: r for r in P.ingest_batch(spark, spark.createDataFrame(rows, COLS), 0, paths).collect()}
    assert set(log) == set(CASES)
    for k, (_, ids, error, blocks, _) in CASES.items():
        got = log[k]
        assert (got.success_count, got.block_count, (got.error or "").split(":")[0] or None) == (len(ids), blocks, error), k
    stored = {r.external_id for r in read(spark, paths.listings, P.KEY).collect()}
    assert stored == set().union(*(c[1] for c in CASES.values()))
    letters = spark.read.parquet(paths.dead_letters).collect()
    assert len(letters) == sum(c[4] for c in CASES.values())
    pages = [r for r in letters if r.reason == "Expected list, got str: Response looks like a CAPTCHA or block page"]
    assert len(pages) == 2 and all(list(r.raw_sample) == [PAGE] for r in pages)
    held = sorted((r.batch_key, r.attempt, r.reason.split(":")[0], r.raw if r.raw == PAGE else json.loads(r.raw)["id"])
                  for r in spark.read.parquet(paths.quarantine).collect())
    keys, text = "Item 1 missing required keys", "Expected list, got str"
    assert held == sorted([("passes-twice", 2, P.NOT_NEEDED, "3"), ("passes-twice", 2, P.NOT_NEEDED, "4"),
                           ("recovers-from-page", 1, text, PAGE), ("recovers-from-keys", 1, keys, "50"), ("recovers-from-keys", 1, keys, "51"),
                           ("fails-twice", 1, text, PAGE), ("fails-twice", 2, keys, "50"), ("fails-twice", 2, keys, "51"),
                           ("fails-once", 1, keys, "50"), ("fails-once", 1, keys, "51"), ("late-and-bad", 2, text, PAGE)])


def test_a_recovered_batch_that_drifts_has_both_letters(spark, scratch):
    from dataclasses import replace

    from feedlake.operators.normalise import REGISTRY

    paths = P.Paths(os.path.join(scratch, "out"))
    feeds = {**REGISTRY, "feed_a": replace(REGISTRY["feed_a"], stable_keys=("epoch",))}
    P.ingest_batch(spark, spark.createDataFrame([("feed_a", "a", 1, body(1))], COLS), 0, paths, feeds)
    bare = json.dumps([{k: v for k, v in rec(i).items() if k != "epoch"} for i in range(10, 14)])
    two = spark.createDataFrame([("feed_a", "b", 1, PAGE), ("feed_a", "b", 2, bare)], COLS)
    log = P.ingest_batch(spark, two, 1, paths, feeds).first()
    assert (log.error, log.block_count, log.schema_drift, log.success_count) == ("schema_drift", 1, True, 0)
    letters = {r.reason.split(":")[0]: list(r.raw_sample) for r in spark.read.parquet(paths.dead_letters).where("batch = 1").collect()}
    assert letters["Expected list, got str"] == [PAGE]
    assert [json.loads(x)["id"] for x in letters["schema_drift"]] == ["10", "11", "12"]


def test_retry_files_belong_to_the_batch_of_the_first(spark, scratch):
    landing, out = os.path.join(scratch, "landing"), os.path.join(scratch, "out")
    os.makedirs(os.path.join(landing, "feed_a"))
    for name, text in {"b1.json": PAGE, "b1.retry.json": body(1, 2), "b2.json": body(3)}.items():
        with open(os.path.join(landing, "feed_a", name), "w") as f:
            f.write(text)
    P.start_ingest(spark, landing, out, os.path.join(scratch, "ck")).awaitTermination(300)
    log = {r.batch_key.rsplit("/", 1)[1]: r for r in spark.read.parquet(os.path.join(out, "run_logs")).collect()}
    assert {k: (r.success_count, r.block_count, r.error) for k, r in log.items()} == {"b1.json": (2, 1, None), "b2.json": (1, 0, None)}


def test_other_attempt_numbers_are_an_error(spark, scratch):
    with pytest.raises(Exception, match="an attempt is 1 or 2"):
        P.ingest_batch(spark, spark.createDataFrame([("feed_a", "a", 3, body(1))], COLS), 0, P.Paths(os.path.join(scratch, "out")))
