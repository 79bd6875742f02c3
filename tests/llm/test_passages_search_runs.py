"""Repeated passages, ranked search and periodic runs against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from feedlake.llm import anchors, periodic, queries, search
from feedlake.llm.common import stash
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def table(spark, rows, schema):
    return stash(spark.createDataFrame(rows, schema), "test-input")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ------------------------------------------------------------ repeated passages

def brute_passages(rows, span):
    first = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - span + 1):
            g, o = tuple(w[a:a + span]), math.inf if i is None else i
            first[g] = min(first.get(g, o), o)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - span + 1):
            if first[tuple(w[a:a + span])] < (math.inf if i is None else i):
                gone[a:a + span] = [True] * span
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), kept))
    return sorted(out, key=repr)


def passages(spark, rows, span, period):
    docs = table(spark, [(i, t, 1, "c") for i, t in rows], "doc_id long, text string, ord int, row string")
    return sorted((tuple(r) for r in anchors.without_passages(docs, span=span, period=period).collect()), key=repr)


@pytest.mark.parametrize("period", [1, 2, 3, 5, 7, 13, 20, 31])
def test_every_shift_is_a_difference_of_the_cover(period):
    found = anchors.cover(period)
    assert {(a - b) % period for a in found for b in found} == set(range(period))
    assert period != 31 or len(found) == 6


def mingled(rng, n, span):
    """Texts of shared and own stretches, copies, near copies, repeats within a text, few words."""
    pool = [[f"p{j}w{k}" for k in range(int(rng.integers(span - 2, 4 * span)))] for j in range(6)]
    rows = []
    for i in range(n):
        w = []
        for _ in range(int(rng.integers(1, 5))):
            p = pool[int(rng.integers(0, len(pool)))]
            a = int(rng.integers(0, max(1, len(p) - span)))
            w += [str(x) for x in rng.integers(0, 3, int(rng.integers(0, 2 * span)))] + p[a:a + int(rng.integers(span - 3, 3 * span))]
        rows.append((int(rng.integers(0, 10 ** 6)), "\n ".join(w)))
    rows += [(i + 1, rows[0][1]) for i in range(40)]
    rows += [(i + 100, rows[1][1].replace("w3", "W3", 1)) for i in range(10)]
    return rows


@pytest.mark.parametrize("seed,span,period", [(1, 6, 4), (2, 9, 7), (3, 12, 7), (4, 50, 31)])
def test_passages_equal_brute_force(spark, seed, span, period):
    rows = mingled(np.random.default_rng(seed), 60, span)
    rows += [(None, rows[2][1]), (None, rows[2][1]), (7, None), (8, ""), (9, " \n"), rows[3], (-5, rows[4][1]), (11, "x " * (3 * span)), (12, "x " * (2 * span)),
             (13, "é\x0bÉ\x1cx  " * span), (14, "é É\x1cx " * (span + 1)), (15, "w" * 300 + " " + rows[5][1] * 40)]
    assert passages(spark, rows, span, period) == brute_passages(rows, span)


def test_passages_shuffled_to_the_texts_and_in_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(anchors, "SMALL", 1)
    monkeypatch.setattr(anchors, "CHUNK", 500)
    rows = mingled(np.random.default_rng(9), 40, 8)
    assert passages(spark, rows, 8, 5) == brute_passages(rows, 8)
    assert passages(spark, [], 8, 5) == []


def test_op11_equals_brute_force_on_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries.op11_passages(spark, SF).collect()), key=repr)
    want = sorted(((i, n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in brute_passages(rows, 50)), key=repr)
    assert got == want and sum(m for _, _, m, _ in got) > 0


# ------------------------------------------------------------ ranked search

def brute_search(docs, items, k=10):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    own = [re.findall(search.TERM, (t or "").translate(low)) for _, t in docs]
    df = Counter(x for w in own for x in set(w))
    total, length = sum(bool(w) for w in own), sum(map(len, own))
    texts = defaultdict(set)
    for i, t in items:
        texts[i].add(t)
    out = []
    for i, ts in texts.items():
        asked = Counter(x for t in ts for x in re.findall(search.TERM, (t or "").translate(low)))
        scores = []
        for (d, _), w in zip(docs, own):
            tf, m = Counter(w), 25 + (75 * len(w) * total) // max(1, length)
            s = sum(n * math.floor(1000 * math.log((2 * total + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf[x] // (1000 * tf[x] + 8 * m)) for x, n in asked.items() if tf[x])
            scores.append((-s, d is None, d))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k]) if s < 0]
    return sorted(out, key=repr)


def found(spark, docs, items, k=10):
    docs = table(spark, [(i, t, 1, 2, "s") for i, t in docs], "doc_id long, text string, row int, n int, shard string")
    items = table(spark, [(i, t, 0) for i, t in items], "item_id long, text string, term int")
    return sorted((tuple(r) for r in search.search(docs, items, k).collect()), key=repr)


def corpus(seed, n=400):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{min(int(rng.pareto(0.7)), 300)}"
    docs = [(int(rng.integers(0, 5000)), " ".join(word() for _ in range(int(rng.integers(1, 80))))) for _ in range(n)]
    docs += [(i, docs[5][1]) for i in range(9000, 9030)] + [docs[6], docs[6], (None, docs[7][1]), (None, docs[7][1]), (1, None), (2, ""), (3, "?! \x00"), (4, "Ünü w1 ÜNÜ W1-w2"), (5, "w3 " * 9000)]
    items = [(i, " ".join(word() for _ in range(int(rng.integers(1, 20))))) for i in range(30)]
    items += [(50, "w1 w1 w1 w2"), (51, "nowhere"), (52, None), (53, ""), (None, "w9 Ünü"), (54, "w4"), (54, "w5"), (54, "w5"), (55, docs[5][1]), (56, "w3 ünü ÜNÜ")]
    return docs, items


@pytest.mark.parametrize("shard", [10 ** 6, 700])
def test_search_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(search, "SHARD", shard)
    docs, items = corpus(1)
    assert found(spark, docs, items) == brute_search(docs, items)
    assert found(spark, docs, items, 3) == brute_search(docs, items, 3)


def test_search_in_blocks_of_queries_and_of_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK", 60)
    monkeypatch.setattr(search, "CHUNK", 200)
    docs, items = corpus(2, 150)
    assert found(spark, docs, items) == brute_search(docs, items)
    assert found(spark, [], items[:3]) == [] and found(spark, docs[:20], []) == []


def test_best_positions_stop_early_and_never_later_than_last_read_positions():
    rng = np.random.default_rng(4)
    doc, term = np.nonzero(rng.random((3000, 8)) < 0.6)
    impact = (1000 * rng.pareto(1.5, len(doc))).astype(np.int64) + 1
    impact[doc < 40] += 20_000  # good in all their lists
    shard = search.Shard(3000, doc, term, impact, 8)
    weights = np.arange(1, 9)
    top, score, scored = shard.best(np.arange(8), weights, 10)
    whole = np.zeros(3000, np.int64)
    np.add.at(whole, doc, weights[term] * impact)
    want = np.lexsort((np.arange(3000), -whole))[:10]
    assert top.tolist() == want.tolist() and score.tolist() == whole[want].tolist()
    assert scored < 1500


# ------------------------------------------------------------ periodic runs

def brute_runs(w):
    runs = []
    for q in range(1, len(w) // 4 + 1):
        a = 0
        while a < len(w) - q:
            z = a
            while z < len(w) - q and w[z] == w[z + q]:
                z += 1
            n = z + q - a
            if z > a and n >= max(6, 4 * q) and not any(all(w[i] == w[i + d] for i in range(a, a + n - d)) for d in range(1, q)):
                runs.append((a, n, q))
            a = max(z, a + 1)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def brute_periodic(i, t, change):
    w, h = words(t), zlib.crc32(("" if i is None else str(i)).encode())
    if change and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
    runs = brute_runs(w)
    gone = {x for a, n, q in runs for x in range(a + q, a + n)}
    first = min(((-n, a, q) for a, n, q in runs), default=None)
    best = (first[1], -first[0], first[2], 1000 * -first[0] // first[2]) if first else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (i, len(runs), *best, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))


def test_runs_of_short_sequences_equal_brute_force():
    rng = np.random.default_rng(11)
    for _ in range(3000):
        w = []
        while len(w) < 40:
            piece = rng.integers(0, int(rng.integers(1, 4)), int(rng.integers(1, 6))).tolist()
            w += (piece * int(rng.integers(1, 9)))[:int(rng.integers(1, 30))]
        assert periodic.find(np.array(w)) == brute_runs(w), w


def test_runs_of_nested_periods_and_long_sequences():
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    inner = ([1] * 7 + [2]) * 9 + [3]
    for w in (fib[-1] * 4, inner * 5, [1, 2] * 200 + [2, 1] * 200, [1] * 700, list(range(90)) * 4 + [7], list(range(90)) * 3 + list(range(89))):
        assert periodic.find(np.array(w)) == brute_runs(w)
    assert periodic.find(np.arange(50_000) % 9_999) == [(0, 50_000, 9_999)]
    assert periodic.find(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]


def test_periodic_runs_of_odd_texts(spark):
    texts = [None, "", " \n\t", "a a a a a", "a a a a a a", "A a " * 30, "x y\x0bx  y x y x y", "é è " * 8 + "\x1c", "a b c " * 3, "one " + "a b c d " * 4 + "two", "z " * 700, "a a a a a a", "a\x85a " * 7]
    docs = table(spark, [(i if i != 3 else None, t, 1, "r") for i, t in enumerate(texts)], "doc_id long, text string, start int, runs string")
    got = sorted((tuple(r) for r in periodic.digests(periodic.periodic_runs(docs)).collect()), key=repr)
    assert got == sorted((brute_periodic(i if i != 3 else None, t, False) for i, t in enumerate(texts)), key=repr)
    assert periodic.digests(periodic.periodic_runs(docs.limit(0))).count() == 0
    kept = {r["doc_id"]: r["collapsed"] for r in periodic.periodic_runs(docs).collect()}
    assert kept[9] == "one a b c d two" and kept[4] == "a"


def test_looping_of_odd_texts(spark):
    rows = [(i, t) for i in range(400) for t in ("a b  c d\ne f g h i j k l", None, "", "  one")[:4 if i < 60 else 1]] + [(None, "a b c")]
    docs = table(spark, rows, "doc_id long, text string")
    got = periodic.digests(periodic.periodic_runs(docs.select("doc_id", periodic.looped(F.col("doc_id"), F.col("text")).alias("text"))))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted((brute_periodic(i, t, True) for i, t in rows), key=repr)


def test_op13_equals_brute_force_on_the_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [r for r in docs.collect() if len(words(r["text"])) <= 400]
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic(spark, SF).collect()}
    assert len(got) == docs.count()
    for r in rows:
        assert got[r["doc_id"]] == brute_periodic(r["doc_id"], r["text"], True)


def test_op12_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    assert sorted(tuple(r) for r in queries.op12_search(spark, SF).collect()) == sorted(con.sql(search.OP12_SQL).fetchall())
