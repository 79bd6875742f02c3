"""Repeated rows and null keys in an upsert."""

from feedlake.operators import upsert as U


def test_repeated_rows_and_null_keys_are_kept_once(spark):
    rows = [("a", 1, "old"), ("a", 2, "new"), ("a", 2, "new"), (None, 1, "x"), (None, 3, "y"), ("b", None, "z"), ("b", None, "z")]
    batch = spark.createDataFrame(rows, "key string, seq int, v string")
    want = {("a", 2, "new"), (None, 3, "y"), ("b", None, "z")}
    got = [tuple(r) for r in U.latest_per_key(batch, ["key"], ["seq"]).collect()]
    assert set(got) == want and len(got) == 3
    target = spark.createDataFrame([(None, 0, "t", 7), ("c", 0, "t", 8)], "key string, seq int, v string, more int")
    got = [tuple(r) for r in U.merge(target, batch, ["key"], ["seq"]).select("key", "seq", "v", "more").collect()]
    assert sorted(got, key=repr) == sorted([(None, 3, "y", 7), ("a", 2, "new", None), ("b", None, "z", None), ("c", 0, "t", 8)], key=repr)
    assert U.duplicate_keys(U.merge(target, batch, ["key"], ["seq"]), ["key"]).count() == 0
