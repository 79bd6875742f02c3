"""Distributed rewrites of sequential rules checked against plain-Python restatements."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedlake.operators import cooldown as CD
from feedlake.operators import dedup as D
from feedlake.operators import ops as O
from feedlake.operators import requests as RQ
from feedlake.operators import upsert as U
from feedlake.sources import fetch as FT


def _sequential_two_key(rows: list[tuple]) -> list:
    """DED-3 row by row: rows are (order, pair, url)."""
    seen_p, seen_u, out = set(), set(), []
    for o, p, u in sorted(rows):
        if p in seen_p or u in seen_u:
            continue
        seen_p.add(p)
        seen_u.add(u)
        out.append(o)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_two_key_dedup_matches_sequential(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, f"p{rnd.randrange(25)}", f"u{rnd.randrange(20)}") for i in range(300)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "o long, p string, u string")
    stats = {}
    got = sorted(r.o for r in D.greedy_two_key(df, F.col("o"), F.col("p"), F.col("u"), stats=stats).collect())
    assert got == sorted(_sequential_two_key(rows))
    assert stats["rounds"] >= 1


def test_two_key_dedup_on_a_chain(spark):
    # each row conflicts with the next: the rounds must run until the chain is resolved
    rows = []
    for i in range(12):
        rows.append((i, f"p{i // 2}", f"u{(i + 1) // 2}"))
    df = spark.createDataFrame(rows, "o long, p string, u string")
    got = sorted(r.o for r in D.greedy_two_key(df, F.col("o"), F.col("p"), F.col("u")).collect())
    assert got == _sequential_two_key(rows)


def test_two_key_with_null_keys_and_repeated_orders(spark):
    rows = [(1, None, "u1"), (2, None, "u2"), (3, "p", None), (4, "q", None), (5, "r", "u5"), (5, "r", "u5"), (6, "s", "u6"), (6, "s", "u7")]
    df = spark.createDataFrame(rows, "o long, p string, u string")
    got = D.greedy_two_key(df, F.col("o"), F.col("p"), F.col("u"), max_rounds=8)
    assert sorted((r.o, r.p, r.u) for r in got.collect() if r.p and r.u) == [(5, "r", "u5"), (6, "s", "u6")]
    assert sorted(r.o for r in got.collect()) == [1, 3, 5, 6]


def test_strip_of_unicode_blanks_and_json_ld_blocks(spark):
    from feedlake.functions.text import pystrip
    from feedlake.operators.extract import extract_listing

    texts = ["\u00a0Find\u3000", "\x1c a b\x85", "\t\n x", "\ufeffy"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.t for r in df.select(pystrip(F.col("t")).alias("t")).collect()] == [t.strip() for t in texts]
    ld = "<script type='application/LD+json'>{}</script>".format
    pages = [ld('{"@type":"Organization","name":"Acme"}') + ld('{"@type":"JobPosting","title":"Nurse"}'),
             ld('[{"@type":"Organization","name":"Acme"},{"@type":"JobPosting","title":"Cook"}]'),
             ld('{"@graph":[{"@type":"WebSite","name":"W"},{"@type":"JobPosting","title":"Smith"}]}'),
             ld("{broken") + "<title>T</title>", ld('{"name":"Only"}'), "<h1>H <b>1</b></h1>"]
    got = extract_listing(spark.createDataFrame(list(enumerate(pages)), "i long, html string"), "html", ["i"]).orderBy("i").collect()
    assert [(r.title, r.method) for r in got] == [("Nurse", "json-ld"), ("Cook", "json-ld"), ("Smith", "json-ld"), ("T", "title"),
                                                  ("Only", "json-ld"), ("H 1", "h1")]


def _sequential_cooldown(times, delta):
    until, out = None, []
    for t in sorted(times):
        if until is None or t[0] >= until:
            until = t[0] + delta
            out.append(t[1])
    return out


@pytest.mark.parametrize("seed", [5, 6])
def test_cooldown_chain_matches_fold(spark, seed):
    rnd = random.Random(seed)
    base = datetime(2024, 1, 1)
    rows = []
    for eid in range(400):
        key = rnd.choice([1, 2, 3, 3, 3, 3])  # key 3 is hot
        rows.append((key, base + timedelta(seconds=rnd.randrange(0, 20 * 86400)), eid))
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz, eid long")
    got = {}
    for r in CD.chain(df, "k", "ts", "eid", 86400.0, bucket_s=7200).collect():
        got.setdefault(r.k, []).append(r.eid)
    for k in {r[0] for r in rows}:
        times = [(r[1], r[2]) for r in rows if r[0] == k]
        expect = _sequential_cooldown(times, timedelta(seconds=86400))
        assert sorted(got[k]) == sorted(expect)


def test_take_while(spark):
    rows = [(1, 0, 200, True), (1, 1, 200, True), (1, 2, 500, True), (1, 3, 200, True),
            (2, 0, 200, True), (2, 1, 200, False), (2, 2, 200, True),
            (3, 0, 500, True)]
    df = spark.createDataFrame(rows, "f long, r long, status int, cur boolean")
    got = sorted((x.f, x.r) for x in FT.take_while(df, "f", "r", F.col("status") != 200, ~F.col("cur")).collect())
    assert got == [(1, 0), (1, 1), (2, 0), (2, 1)]


def _merge(spark, batches, total):
    rows = [(1, r, p, j) for r, b in enumerate(batches) for p, j in enumerate(b)]
    df = spark.createDataFrame(rows, "f long, r long, p long, j string")
    return [x.j for x in FT.cursor_merge(df, "f", "r", "p", "j", total).orderBy("r", "p").collect()]


def test_cursor_merge_dedups_across_batches_and_caps(spark):
    b1 = [f"id{i}" for i in range(10)]
    b2 = [f"id{i}" for i in range(5, 15)]  # overlap of five
    assert len(_merge(spark, [b1, b2], 50)) == 15
    assert _merge(spark, [b1, b2], 12) == b1 + ["id10", "id11"]
    assert _merge(spark, [["", "a", "", "a"]], 10) == ["", "a", ""]


def test_envelope_shapes(spark):
    bodies = ['{"data": {"jobs": [{"job_id": "x"}], "cursor": "c2"}}', '{"data": [{"job_id": "y"}]}',
              '[{"job_id": "z"}]', '"oops"']
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    out = df.select(FT.unwrap_envelope(F.col("b")).alias("u")).collect()
    assert [len(r.u.jobs) for r in out] == [1, 1, 1, 0]
    assert [r.u.cursor for r in out] == ["c2", None, None, None]


def test_prompts(spark):
    cases = [("Find data analyst jobs in India", ("data analyst", "in", None, False)),
             ("Remote python developer in Texas, USA", ("python developer", "us", "Texas", True)),
             ("", (None, None, None, False)),
             ("Getty jobs", ("ty", None, None, False)),
             ("show me nurse roles in Austin", ("nurse", None, "Austin", False))]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, prompt string")
    got = {r.i: (r.role, r.country, r.location, r.remote_only)
           for r in RQ.parse_prompts(df, "prompt", ["i"]).collect()}
    for i, (_, expect) in enumerate(cases):
        assert got[i] == expect


def test_request_plan(spark):
    rows = [(1, "  data engineer ", True, " GB ", "London", True, 20),
            (2, None, False, None, None, False, None),
            (3, "x", True, None, "", False, 900),
            (4, "x", True, None, "", False, 0)]
    df = spark.createDataFrame(rows, "i int, role string, country_given boolean, country string, location string, "
                                     "remote_only boolean, total_jobs int").withColumn(
        "page", F.lit(0)).withColumn("num_pages", F.lit(1)).withColumn("date_posted", F.lit("all"))
    got = {r.i: r for r in RQ.plan_requests(df, ["i"]).collect()}
    assert (got[1].query, got[1].country, got[1].location, got[1].work_from_home) == (
        "data engineer", "gb", "London", "true")
    assert (got[2].query, got[2].country, got[2].total_jobs) == ("Software Engineer", "us", 10)
    assert got[3].country is None and got[3].location is None and got[3].total_jobs == 500
    assert not got[4].valid and got[4].error == "total_jobs must be >= 1, got 0"
    assert got[1].page == 1


def test_upsert_twice_is_idempotent(spark):
    t = spark.createDataFrame([], "source string, external_id string, v long")
    b = spark.createDataFrame([("a", "1", 1), ("a", "2", 2)], "source string, external_id string, v long")
    keys = ["source", "external_id"]
    first = U.merge(t, b, keys, ["v"])
    c1 = U.upsert_counts(t, b, keys).first()
    second = U.merge(first, b, keys, ["v"])
    c2 = U.upsert_counts(first, b, keys).first()
    assert first.count() == second.count() == 2
    assert (c1.insert_count, c1.update_count) == (2, 0)
    assert (c2.insert_count, c2.update_count) == (0, 2)


def test_last_write_wins_in_batch(spark):
    b = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "key string, seq long, v string")
    assert U.latest_per_key(b, ["key"], ["seq"]).first().v == "new"


def test_gaps_match_brute_force(spark):
    rnd = random.Random(9)
    base = datetime(2024, 1, 1)
    rows = [(rnd.choice([1, 2, 2, 2]), base + timedelta(seconds=rnd.randrange(0, 3 * 86400)), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz, eid long")
    got = {r.eid: r.gap_s for r in O.consecutive_gaps(df, "k", "ts", "eid", bucket_seconds=1800).collect()}
    for k in (1, 2):
        seq = sorted((r[1], r[2]) for r in rows if r[0] == k)
        prev = None
        for ts, eid in seq:
            expect = None if prev is None else (ts - prev).total_seconds()
            assert got[eid] == pytest.approx(expect) if expect is not None else got[eid] is None
            prev = ts


def test_lognormal_delays(spark):
    import math

    df = spark.range(2000)
    vals = [r.d for r in df.select(RQ.lognormal_delays(2.0, 0.4, "id").alias("d")).collect()]
    mean = sum(vals) / len(vals)
    assert abs(mean - 2.0 * math.exp(0.4 ** 2 / 2)) / (2.0 * math.exp(0.4 ** 2 / 2)) < 0.15
    assert min(vals) > 0
    assert sorted(vals)[len(vals) // 2] < mean
    with pytest.raises(ValueError):
        RQ.lognormal_delays(0.0, 0.4, "id")
