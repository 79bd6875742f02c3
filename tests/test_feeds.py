"""Normalisers, validation, drift, block pages: behaviours on small fixtures."""

import json

from pyspark.sql import functions as F

from feedlake.operators import normalise as N
from feedlake.operators import quality as Q
from feedlake.schema import CANONICAL_FIELDS


def _records(spark, items, source="feed_a", batch=1):
    rows = [(source, batch, i, json.dumps(x)) for i, x in enumerate(items)]
    return spark.createDataFrame(rows, "source string, batch_id bigint, pos bigint, raw string")


FLAT = [
    {"id": "a-1", "position": "Data Engineer", "company": "Acme", "url": "https://remoteOK.com/x/1",
     "epoch": 1700000000, "salary_min": "90000", "salary_max": "120000", "tags": ["python", "spark"]},
    {"id": 77, "position": "Analyst", "company": "Beta", "slug": "analyst-77", "date": "1700003600",
     "salary_min": None, "salary_max": 12.9, "location": ""},
]


def test_flat_feed_two_records_and_metadata(spark):
    payload = json.dumps([{"legal": "terms of use"}] + FLAT)
    p = spark.createDataFrame([("feed_a", 1, payload)], "source string, batch_id bigint, payload string")
    manifest, records = Q.scan_payloads(p, key_field="id")
    assert manifest.first()["n_items"] == 2
    out = {r["external_id"]: r for r in N.normalise_flat(records).collect()}
    assert set(out) == {"a-1", "77"}
    a, b = out["a-1"], out["77"]
    assert (a.salary_min, a.salary_max) == (90000, 120000)
    assert a.visa_sponsorship is None and a.four_day_week is None and a.remote is True
    assert a.url == "https://remoteok.com/x/1"
    assert a.tags == ["python", "spark"]
    assert str(a.posted_at) == "2023-11-14 22:13:20"
    assert b.url == "https://remoteok.com/remote-jobs/analyst-77"
    assert b.salary_min is None and b.salary_max == 12
    assert b.location == "Worldwide / Remote"
    assert str(b.posted_at) == "2023-11-14 23:13:20"


def test_flat_feed_without_id_is_dropped(spark):
    df = _records(spark, [{"position": "x", "company": "y", "url": "z"}])
    assert N.normalise_flat(df).count() == 0


CURSOR = [
    {"job_id": "j1", "job_title": "Backend Dev", "employer_name": "Gamma", "job_apply_link": "https://g/1",
     "job_city": "Mountain View", "job_state": "CA", "job_country": "US", "job_is_remote": False,
     "job_posted_at_datetime_utc": "2024-03-01T10:00:00Z", "job_min_salary": 180000.0, "job_max_salary": 0,
     "required_technologies": ["Go", "", "SQL"], "job_function": "Engineering", "job_employment_type": "FULLTIME"},
    {"job_id": "j2", "job_title": "SRE", "job_apply_link": "https://g/2", "work_arrangement": "remote",
     "job_posted_at_timestamp": 1709287200, "job_min_salary": "0", "job_location": "Berlin"},
]


def test_cursor_feed_two_records(spark):
    out = {r["external_id"]: r for r in N.normalise_cursor(_records(spark, CURSOR, "feed_b")).collect()}
    a, b = out["j1"], out["j2"]
    assert "Mountain View" in a.location and a.location == "Mountain View, CA, US"
    assert a.salary_min == 180000 and a.salary_max is None
    assert a.tags == ["go", "sql", "engineering", "fulltime"]
    assert str(a.posted_at) == "2024-03-01 10:00:00"
    assert a.remote is False and b.remote is True
    assert b.salary_min == 0 and b.location == "Berlin"
    assert str(b.posted_at) == "2024-03-01 10:00:00"


def test_cursor_feed_without_job_id_is_dropped(spark):
    df = _records(spark, [{"job_title": "x", "job_apply_link": "y"}], "feed_b")
    assert N.normalise_cursor(df).count() == 0


def test_iso_failure_does_not_fall_through(spark):
    rec = {"job_id": "j", "job_posted_at_datetime_utc": "yesterday", "job_posted_at_timestamp": 1709287200}
    r = N.normalise_cursor(_records(spark, [rec], "feed_b")).first()
    assert r.posted_at is None


def test_paged_feed_truthiness(spark):
    recs = [{"slug": "s1", "title": "t", "company_name": "c", "url": "u", "visa_sponsorship": True,
             "remote": "yes", "created_at": 1700000000},
            {"slug": "", "title": "t", "company_name": "c", "url": "u"}]
    out = N.normalise_paged(_records(spark, recs, "feed_c")).collect()
    assert len(out) == 1
    r = out[0]
    assert r.visa_sponsorship is True and r.four_day_week is False and r.remote is True
    assert r.salary_min is None and r.location == ""


def test_all_normalisers_share_the_canonical_columns(spark):
    a = N.normalise_flat(_records(spark, FLAT))
    b = N.normalise_cursor(_records(spark, CURSOR, "feed_b"))
    c = N.normalise_paged(_records(spark, [{"slug": "s", "title": "t", "company_name": "c", "url": "u"}], "feed_c"))
    assert a.columns == b.columns == c.columns == CANONICAL_FIELDS
    types = lambda df: [(f.name, f.dataType) for f in df.schema]
    assert types(a) == types(b) == types(c)
    assert N.unify(a, b, c).count() == 5


def _verdict(spark, payload, required, min_items=1):
    p = spark.createDataFrame([("feed_a", 1, payload)], "source string, batch_id bigint, payload string")
    m, r = Q.scan_payloads(p, key_field=None)
    return Q.batch_verdicts(m, r, required, min_items).first()


def test_validation_ladder(spark):
    req = ["id", "url"]
    assert _verdict(spark, json.dumps([{"id": 1, "url": "u"}]), req).ok
    v = _verdict(spark, "[]", req)
    assert not v.ok and v.reason == "Too few items: got 0, expected >= 1"
    v = _verdict(spark, json.dumps({"data": []}), req)
    assert not v.ok and v.reason == "Expected list, got dict"
    v = _verdict(spark, json.dumps([{"id": 1}]), req)
    assert v.reason == "Item 0 missing required keys: {'url'}" and v.missing == ["url"]
    v = _verdict(spark, json.dumps([{"id": 1, "url": None}, {"x": 2}]), req)
    assert v.reason == "Item 1 missing required keys: {'id', 'url'}"
    v = _verdict(spark, json.dumps([{"id": 1, "url": "u"}]), req, min_items=2)
    assert v.reason == "Too few items: got 1, expected >= 2"


def test_block_pages(spark):
    texts = ["<html>Please complete the CAPTCHA</html>", "Access Denied by policy",
             "Checking your browser... Cloudflare Ray ID: 123", '{"data": [1, 2, 3]}']
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    flags = [r.is_block for r in Q.block_pages(df, "text").collect()]
    assert flags == [True, True, True, False]


def _drift(spark, docs, known, **kw):
    recs = spark.createDataFrame([("s", 1, i, json.dumps(d)) for i, d in enumerate(docs)],
                                 "source string, batch_id bigint, pos bigint, raw string")
    snaps = spark.createDataFrame([("s", known)], "source string, fields array<string>")
    return {r.field for r in Q.schema_drift(Q.record_keys(recs), snaps, **kw).collect()}


def test_schema_drift(spark):
    known = ["a", "b", "c"]
    assert _drift(spark, [{"a": 1, "b": 2}] * 3, known) == {"c"}
    assert _drift(spark, [{"a": 1, "b": 2}] + [{"a": 1, "b": 2, "c": 3}] * 3, known) == set()
    assert _drift(spark, [{"a": 1}], []) == set()
    assert _drift(spark, [], known) == set()
    # the whole batch votes, or its first documents where a sample size is given
    assert _drift(spark, [{"a": 1, "b": 1, "c": 1}] * 5 + [{"a": 1}] * 20, known) == {"b", "c"}
    assert _drift(spark, [{"a": 1, "b": 1, "c": 1}] * 5 + [{"a": 1}] * 20, known, sample_size=5) == set()


def test_dead_letter_samples_first_three(spark):
    p = spark.createDataFrame([("feed_a", 1, json.dumps([{"x": i} for i in range(6)]))],
                              "source string, batch_id bigint, payload string")
    m, r = Q.scan_payloads(p, key_field=None)
    v = Q.batch_verdicts(m, r, ["id"])
    dl = Q.dead_letters(r, v, F.lit(None).cast("timestamp_ntz")).first()
    assert [json.loads(x)["x"] for x in dl.raw_sample] == [0, 1, 2]
    assert json.loads(dl.details) == {"missing": ["id"]}
