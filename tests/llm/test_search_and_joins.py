"""Top-k, repeats, exact copies, near copies and sharding against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from feedlake.llm import exact_dedup, ngram_join, repeats, topk
from feedlake.llm.common import components, stash
from feedlake.llm.sharding import shard
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"


def table(spark, rows, schema):
    return stash(spark.createDataFrame(rows, schema), "test-input")


def docs_of(spark, texts, ids=None):
    """Documents with further columns whose names the operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    return table(spark, [(i, t, "x", 1, 2, False) for i, t in zip(ids, texts)],
                 "doc_id long, text string, digest string, row long, _row long, kept boolean")


# ------------------------------------------------------------ top-k

def brute_topk(rows, k=20, every=20):
    whole = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [float(np.floor(64 * float(np.float32(x)))) for x in v]
        whole[i] = min(whole.get(i, q), q)
    out = set()
    for q, a in whole.items():
        if q % every == 0:
            s = sorted((-sum(int(x) * int(y) for x, y in zip(a, b)), c) for c, b in whole.items() if c != q)
            out |= {(q, r + 1, c, -x) for r, (x, c) in enumerate(s[:k])}
    return out


def test_topk_equals_brute_force_with_ties_nulls_and_ragged_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 50)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=24).astype(np.float32)]) for i in range(230)]
    rows += [(300 + i, rows[5][1]) for i in range(60)]  # a common vector: ties
    rows += [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")]), (404, []), (405, [3.0]), (None, [1.0])]
    rows += [rows[7], (420, [1e3] * 24), (440, [-1e3] * 30)]
    got = topk.top_k(table(spark, rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute_topk(rows)


def test_topk_of_an_empty_table(spark):
    none = table(spark, [], "vec_id long, embedding array<float>")
    assert topk.top_k(none, F.col("vec_id") % 20 == 0).count() == 0


def test_segment_statistics_bound_the_inner_product():
    rng = np.random.default_rng(2)
    q, c = rng.normal(size=(20, 37)), rng.normal(size=(30, 37))
    for s in (1, 4, 16, 64):
        assert (topk.statistics(q, s) @ topk.statistics(c, s).T >= q @ c.T - 1e-9).all()


def test_scores_beyond_doubles_are_exact():
    q, c = np.array([[2.0 ** 40, 1.0]]), np.array([[2.0 ** 20, 1.0], [2.0 ** 52, 3.0]])
    assert topk.scores(q, c).tolist() == [[2 ** 60 + 1, 2 ** 63 - 1]]


# ------------------------------------------------------------ repeated byte strings

def brute_repeats(texts, span=200):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + span] for b in bodies for i in range(len(b) - span + 1))
    out = []
    for b in bodies:
        cut = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i:i + span]] > 1:
                cut[i:i + span] = b"\1" * span
        kept = bytes(x for x, c in zip(b, cut) if not c)
        out.append((len(b), sum(cut), len(re.findall(b"\1+", bytes(cut))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(repeats, "CHUNK", 3000)
    if seed == 2:
        monkeypatch.setattr(repeats, "SMALL", 3)  # the way without broadcasts
    rng = np.random.default_rng(seed)
    word = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    passage, line = word(260), word(199)
    texts = [word(int(rng.integers(0, 600))) for _ in range(30)]
    texts += [word(50) + passage + word(30) for _ in range(12)] + [passage[:230], passage[20:], line + "x", line + "y"]
    texts += [texts[3], texts[3] + "tail", None, "", "a" * 199, "ab" * 300, "z" * 450, "z" * 201, word(200)]
    base = word(900)
    for _ in range(12):
        t = list(base)
        t[int(rng.integers(0, 900))] = "#"
        texts.append("".join(t))
    half = word(150)
    texts += [half + word(150) + half, (word(210) + "|") * 1 + half * 2]
    got = repeats.without_repeats(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_repeats(texts)


def test_a_collision_of_one_identifier_removes_nothing(spark, monkeypatch):
    """With the first identifiers of all bytes made equal for all strings the second ones still part them."""
    plain, pair = repeats.spanned, repeats.bucket
    monkeypatch.setattr(repeats, "spanned", lambda far, lo, p, hi, step=repeats.STEP: plain(far, lo, p, hi, step) * (step != repeats.STEP))
    monkeypatch.setattr(repeats, "bucket", lambda data: (pair(data)[0] if data[:1].isalpha() else 0, pair(data)[1]))
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefgh"), n))
    line, passage = word(150), word(300)
    texts = [word(120) + line + word(120) for _ in range(20)] + [word(90) + passage + word(90) for _ in range(3)] + [word(400)]
    got = repeats.without_repeats(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_repeats(texts)


def test_repeats_of_nothing_and_the_kept_bytes(spark):
    assert repeats.without_repeats(docs_of(spark, [])).count() == 0
    t = "x" * 10 + "".join(chr(97 + i % 26) * (i % 7 + 1) for i in range(100))
    got = repeats.without_repeats(docs_of(spark, [t + "end", "new" + t]), kind="bytes").orderBy("doc_id").collect()
    assert [r["kept"].decode() for r in got] == ["end", "new"]


# ------------------------------------------------------------ exact copies

def brute_exact(ids, texts):
    groups = defaultdict(list)
    for n, (i, t) in enumerate(zip(ids, texts)):
        groups[re.sub(BLANKS, " ", t or "")].append((i is None, i or 0, n))
    first = {t: min(g) for t, g in groups.items()}
    out = []
    for n, (i, t) in enumerate(zip(ids, texts)):
        t = re.sub(BLANKS, " ", t or "")
        f = first[t]
        out.append((i, None if f[0] else f[1], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("k", [2, 1024])
def test_exact_copies_equal_brute_force(spark, k):
    texts = ["a b", "a\t\n b", None, "", "a  b ", "é", "é", "long " * 3000, "long " * 3000, " ", " "] + ["hot"] * 40 + ["a b"] * 3
    ids = [9, 3, 5, 4, 1, 2, 2, 30, 31, None, 7] + list(range(100, 140)) + [3, None, 50]
    got = exact_dedup.exact_dedup(docs_of(spark, texts, ids), k=k).collect()
    rows = [(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got]
    assert sorted(map(repr, rows)) == sorted(map(repr, brute_exact(ids, texts)))
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    stay = exact_dedup.keep_first(docs_of(spark, texts, ids), k=k)
    assert stay.columns == docs_of(spark, [], []).columns
    assert sorted(map(repr, (r["doc_id"] for r in stay.collect()))) == sorted(map(repr, (r["doc_id"] for r in kept)))


def test_exact_copies_of_nothing(spark):
    assert exact_dedup.exact_dedup(docs_of(spark, [])).count() == 0


def test_misra_gries_keeps_frequent_values():
    import pandas as pd
    frames = [pd.DataFrame({"digest": [b"h"] * 30 + [str(i).encode() for i in range(50)]}) for _ in range(3)]
    out = next(exact_dedup._counters(4)(iter(frames)))
    assert len(out) <= 4 and b"h" in set(out["digest"])


# ------------------------------------------------------------ near copies

def brute_near(ids, texts, k=4, num=85, den=100):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset()))
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and den * len(x & sets[j]) >= num * len(x | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(sets)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [(ids[i], len(x), least[root(i)]) for i, x in enumerate(sets)]


@pytest.mark.parametrize("hot", [4, 64])
def test_near_copies_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "CELL", 16)
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    rng = np.random.default_rng(hot)
    words = [f"w{i}" for i in range(300)]
    some = lambda n: list(rng.choice(words, n))
    passage, base, rows = some(40), some(60), []
    for _ in range(50):
        t = list(base)
        for _ in range(int(rng.integers(0, 4))):
            t[int(rng.integers(0, 60))] = some(1)[0]
        rows.append(t)
    rows += [some(int(rng.integers(0, 60))) + passage + some(int(rng.integers(0, 20))) for _ in range(40)]
    for _ in range(25):
        t = list(passage)
        t[int(rng.integers(0, 40))] = some(1)[0]
        rows.append(t[:int(rng.integers(35, 41))])
    rows += [list(rng.choice(words[:6], int(rng.integers(0, 12)))) for _ in range(40)]
    texts = [" ".join(r) for r in rows] + [None, "", " \t\n", "Ä É x", "ä é x", "A B C", "a b\nc", "a b c", "w" * 90000]
    ids = [1000 - i for i in range(len(texts))]
    got = ngram_join.ngram_join(docs_of(spark, texts, ids))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == sorted(brute_near(ids, texts))
    five = brute_near(ids, texts, 5, 80, 100)
    stay = {i for i, n, c in five if not n or i == c}
    assert {r["doc_id"] for r in ngram_join.keep_one(docs_of(spark, texts, ids)).collect()} == stay


def test_a_quotation_of_many_near_copies_makes_no_pairs_of_them(spark, monkeypatch):
    """Distinct near copies of one text, with short quotations of it: linked by their cores, not pair by pair."""
    rng = np.random.default_rng(12)
    base = [f"w{x}" for x in rng.integers(0, 10 ** 6, 300)]
    texts = []
    for i in range(200):
        w = list(base)
        for at in rng.integers(0, 300, 2):
            w[at] = f"x{i}"
        texts.append(" ".join(w))
    texts += [" ".join(base[10:22]), " ".join(base[100:109]), " ".join(base[10:22]) + " z"]
    met, kept = [], ngram_join.components
    monkeypatch.setattr(ngram_join, "components", lambda edges, name: met.append((name, edges.count())) or kept(edges, name))
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(docs_of(spark, texts)).collect()}
    assert {got[i] for i in range(200)} == {0} and got[200] == 200 and got[201] == 201 and got[202] == 200
    assert dict(met)["ngram-candidates"] < 64 * len(texts) and dict(met)["ngram-links"] < 64 * len(texts)


def test_groups_of_near_copies_are_multiplied_once(spark, monkeypatch):
    """Many groups of 20 near copies: the product meets each group once, groups that lie close to each other too."""
    rng, texts = np.random.default_rng(17), []
    shared = [f"s{x}" for x in rng.integers(0, 10 ** 6, 40)]
    for _ in range(12):
        base = shared + [f"w{x}" for x in rng.integers(0, 10 ** 6, 80)]
        texts += [" ".join([*base, f"v{i}", f"v{i + 1}"]) for i in range(20)]
    near = [f"n{x}" for x in rng.integers(0, 10 ** 6, 100)]
    texts += [" ".join(near[:100 - i]) for i in range(30)]  # a chain: its ends are linked by what lies between
    met, kept = [], ngram_join.stash
    monkeypatch.setattr(ngram_join, "stash", lambda df, name: met.append((name, out := kept(df, name))) or out)
    got = ngram_join.ngram_join(docs_of(spark, texts)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute_near(range(len(texts)), texts))
    assert dict(met)["ngram-pairs"].count() < len(texts)  # row by row there are 190 in each group


# ------------------------------------------------------------ numbers of rows

def test_results_do_not_depend_on_how_files_are_split(spark, monkeypatch):
    """Between any two written tables the split of the scans changes, as it does where executors come and go."""
    from feedlake.llm import anchors, common, mixing

    rng = np.random.default_rng(13)
    texts = [" ".join(str(x) for x in rng.integers(0, 40, 30)) + " z" * int(rng.integers(0, 40)) for _ in range(150)]
    texts += [texts[int(rng.integers(0, 150))] + (" q" if i % 2 else "") for i in range(150)]
    rows = [(int(i), t, "ab"[i % 2]) for i, t in zip(rng.permutation(len(texts)), texts)]
    path = stash(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), "test-split").inputFiles()[0].rsplit("/", 1)[0]
    read = lambda: spark.read.parquet(path)
    runs = [lambda: ngram_join.keep_one(read()), lambda: exact_dedup.keep_first(read()), lambda: repeats.without_repeats(read()),
            lambda: anchors.without_passages(read(), span=12, period=7), lambda: mixing.mix(read()).select("doc_id", "text")]
    key = "spark.sql.files.minPartitionNum"
    one = [sorted(map(repr, r().collect())) for r in runs]
    turn = iter(range(10 ** 6))

    def flipping(df, name):
        out = stash(df, name)
        spark.conf.set(key, str((1, 40, 7)[next(turn) % 3]))
        return out
    for module in (ngram_join, exact_dedup, repeats, anchors, mixing, common):
        monkeypatch.setattr(module, "stash", flipping)
    try:
        assert [sorted(map(repr, r().collect())) for r in runs] == one
        spark.conf.set(key, "1")
        few = {r["doc_id"]: r["n"] for r in common.numbered(read(), "n").collect()}
        spark.conf.set(key, "40")
        assert few == {r["doc_id"]: r["n"] for r in common.numbered(read(), "n").collect()} and len(set(few.values())) == len(rows)
    finally:
        spark.conf.unset(key)


def test_near_copies_of_nothing_and_of_repeated_rows(spark):
    assert ngram_join.ngram_join(docs_of(spark, [])).count() == 0
    got = ngram_join.ngram_join(docs_of(spark, ["a b c d e", "a b c d e"], [4, 4])).collect()
    assert [(r["doc_id"], r["component_id"]) for r in got] == [(4, 4)] * 2 and sum(r["kept"] for r in got) == 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(500, 500 + i) for i in range(1, 30)] + [(900, 901), (901, 900), (7, 7)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{i: 500 for i in range(500, 530)}, 900: 900, 901: 900}


# ------------------------------------------------------------ sharding

def test_shards_follow_the_key_and_grow_into_the_new_one(spark):
    texts = [None, "", "é", *("t%d" % i for i in range(400)), "same", "same"]
    ids = [None, 1, 2, *range(10, 410), 500, 500]
    got = shard(docs_of(spark, texts, ids)).collect()
    assert len(got) == len(texts) and {r["law"] for r in got} == {"key"}
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in got)
    moved = sum(r["grown_shard"] == 8 for r in got)
    assert 0.05 * len(got) < moved < 0.2 * len(got)
    for s in range(8):
        own = sorted((r["slot"], r["doc_id"]) for r in got if r["shard"] == s and r["doc_id"] is not None)
        assert [i for _, i in own] == sorted(i for _, i in own)
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert len({r["shard"] for r in got if r["doc_id"] == 500}) == 1


def test_shard_weights_and_no_rows(spark):
    got = shard(docs_of(spark, ["x"] * 600), weights=(3.0, 1.0)).groupBy("shard").count().collect()
    count = {r[0]: r[1] for r in got}
    assert 380 < count[0] < 520 and count[0] + count[1] == 600
    assert shard(docs_of(spark, [])).count() == 0
