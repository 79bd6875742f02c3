"""Mixing and packing as queries over a whole table with copies and a hot group, against brute force."""

from collections import Counter, defaultdict
from fractions import Fraction

import pandas as pd
from pyspark.sql import functions as F

from feedlake.llm import mixing, packing
from feedlake.llm.common import stash
from feedlake.llm.queries import QUERIES
from test_models_and_pipeline import brute_pack


def corpus(spark, scratch):
    """Rows with exact copies, one hot source, a null source and a repeated id; its folder."""
    rows = [(i, " ".join(f"w{i}-{j}" for j in range(i * 7 % 90)), ["hot", "b", None][0 if i % 5 < 4 else 1 + i % 2]) for i in range(700)]
    rows += [(1000 + i, "one copied text of some length " * 9, "hot") for i in range(300)] + [(3, None, "b"), (3, "", "b")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{scratch}/documents.parquet")
    return rows


def fluid(counts, weights):
    """Slot by slot the blocks that are due of each source, for ever shared among those that have not run out; exact."""
    due = {s: Fraction(0) for s in counts}
    for _ in range(sum(counts.values())):
        left = Fraction(1)
        while left:
            rate = sum(Fraction(weights[s]) for s in counts if due[s] < counts[s])
            step = min([left, *((n - due[s]) * rate / Fraction(weights[s]) for s, n in counts.items() if due[s] < n)])
            due = {s: x + step * Fraction(weights[s]) / rate if x < counts[s] else x for s, x in due.items()}
            left -= step
        yield dict(due)


def brute_mix(counts, weights):
    """Of each source the slots of its blocks: all windows, then slot by slot the released block with the earliest deadline."""
    after, names = [dict.fromkeys(counts, Fraction(0)), *fluid(counts, weights)], sorted(counts)
    release = {(s, i): max(t for t, d in enumerate(after) if d[s] <= i) for s, n in counts.items() for i in range(n)}
    deadline = {(s, i): min(t for t, d in enumerate(after) if d[s] >= i + 1) for s, n in counts.items() for i in range(n)}
    out = {s: [] for s in counts}
    for t in range(len(after) - 1):
        ready = [(deadline[s, len(out[s])], s) for s in names if len(out[s]) < counts[s] and release[s, len(out[s])] <= t]
        out[min(ready)[1]].append(t)
    return out


def test_op5_gives_every_row_its_slot(spark, scratch):
    rows = corpus(spark, scratch)
    got = QUERIES["op5_mixing"](spark, scratch)
    assert got.columns == ["doc_id", "source", "mix_slot", "mix_at"]
    own = defaultdict(list)
    for i, _, s in rows:
        own[s].append(i)
    name = lambda s: mixing.NO_SOURCE if s is None else s
    slots = brute_mix({name(s): -(-len(x) // mixing.BLOCK) for s, x in own.items()}, {name(s): len(x) ** 0.5 for s, x in own.items()})
    want = Counter((i, s, slots[name(s)][n // mixing.BLOCK], n % mixing.BLOCK) for s, x in own.items() for n, i in enumerate(sorted(x)))
    assert Counter(map(tuple, got.collect())) == want


def order_of(spark, counts, weights):
    """The sources in the order of slots, blocks being single documents."""
    docs = stash(spark.createDataFrame([(i, s) for s, n in counts.items() for i in range(n)], "doc_id long, source string"), "test-input")
    got = mixing.schedule(docs, weights, block=1).orderBy("mix_slot").collect()
    assert [r["mix_slot"] for r in got] == list(range(sum(counts.values()))) and {r["mix_at"] for r in got} == {0}
    return [r["source"] for r in got]


def test_exact_weights_hold_over_many_periods(spark):
    counts, weights = {"a": 8000, "b": 30, "c": 16000}, {"a": 0.3334567, "b": 0.0001, "c": 1 - 0.3334567 - 0.0001}
    seen, total = Counter(), sum(map(Fraction, weights.values()))
    for t, s in enumerate(order_of(spark, counts, weights), 1):
        seen[s] += 1
        if t < 23900:  # none has run out
            assert all(abs(seen[x] - t * Fraction(w) / total) < 1 for x, w in weights.items()), t
    few = {"a": 300, "b": 100, "c": 7}
    share, seen = {"a": 0.5, "b": 0.4, "c": 0.1}, Counter()
    for s, due in zip(order_of(spark, few, share), fluid(few, share)):
        seen[s] += 1
        assert all(abs(seen[x] - d) < 1 for x, d in due.items())


def test_exact_weights_hold_with_more_sources_than_slots_of_a_batch(spark):
    small = [f"s{i}" for i in range(1999)]
    counts, weights = {"big": 1200} | dict.fromkeys(small, 2), {"big": 1 / 3} | dict.fromkeys(small, 2 / 3 / 1999)
    total, seen = sum(map(Fraction, weights.values())), Counter()
    for t, s in enumerate(order_of(spark, counts, weights)[:3590], 1):
        seen[s] += 1
        assert abs(seen["big"] - t * Fraction(weights["big"]) / total) < 1
        assert abs(seen[s] - t * Fraction(weights[s]) / total) < 1


def test_op6_packs_the_whole_table_as_a_scan_of_all_bins(spark, scratch):
    rows = corpus(spark, scratch)
    bit = F.pmod(F.xxhash64("cluster"), F.lit(packing.BITS))
    got = QUERIES["op6_packing"](spark, scratch).withColumn("bit", F.when(F.col("cluster").isNotNull(), bit)).toPandas()
    size = [len((t or "").encode()) for _, t, _ in rows]
    assert len(got) == len(rows)
    assert got.groupby("doc_id")["piece_bytes"].sum().to_dict() == {r[0]: sum(n for q, n in zip(rows, size) if q[0] == r[0]) for r in rows}
    assert got.loc[got["doc_id"] >= 1000, "cluster"].nunique() == 1 and got.loc[got["doc_id"] >= 1000, "bin_id"].is_unique
    bits = {i: None if pd.isna(b) else int(b) for i, b in zip(got["doc_id"], got["bit"]) if i != 3} | {3: int(got.loc[got["bit"].notna() & (got["doc_id"] == 3), "bit"].iloc[0])}
    order = sorted(range(len(rows)), key=lambda i: (-size[i], i))
    bins = brute_pack([(i, size[i], rows[i][2], bits[rows[i][0]] if size[i] else None) for i in order], packing.CAPACITY, packing.SOURCE_SHARE)
    whole, mine = defaultdict(list), defaultdict(list)
    for i, b in bins.items():
        whole[b].append(rows[i][0])
    for i, b in zip(got["doc_id"], got["bin_id"]):
        mine[b].append(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, whole.values()))
