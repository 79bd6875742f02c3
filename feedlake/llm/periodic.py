"""Periodic runs of words by recursive frequency splitting.

A run is a stretch of words with smallest period q (words q apart are the same),
of max(LEAST, TIMES q) words at least, that no neighbouring word extends. Each of
its words stands in it TIMES times at least. So a word that stands fewer times in
a segment is in no run of it and splits it; the pieces are split again until
nothing changes, and pieces under LEAST words go.

What survives is scanned by lags in classes B <= q < 2B, B a power of two. Of a
run with such a period, some multiple c of B has the 2B words from c and those
from c + q within the run. So the name of the 2B words at each multiple of B is
compared with those at all lags of the class: as many comparisons a class as the
segment has words. Two lags that agree at one place mean a period that divides
both, so only single ones are followed: they are extended word by word, and kept
if no divisor of the lag is a period too. Names are 64-bit hashes, but every run
is proven on the words.

A text is split and scanned where it lies; nothing is shuffled or collected.

Defined cases: null and empty texts, or blanks only, have no words and no runs;
repeated rows are judged alike; a null id is kept; an empty table gives no rows;
further columns are not read. A task holds one text's words at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import BLANKS, ship
from feedlake.llm.shingles import STEP, mixed

#: Least words of a run, and least times that its period goes into it.
LEAST, TIMES = 6, 4
#: Bytes of text that are answered at a time.
ANSWER = 1 << 22


def segments(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches, LEAST words at least, in each of which every word stands TIMES times at least."""
    work = [(0, len(ids))]
    while work:
        a, b = work.pop()
        if b - a < LEAST:
            continue
        _, code, n = np.unique(ids[a:b], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(n[code] < TIMES)
        if not len(rare):
            yield a, b
            continue
        start, end = a + np.concatenate([[0], rare + 1]), a + np.concatenate([rare, [b - a]])
        long = end - start >= LEAST
        work.extend(zip(start[long].tolist(), end[long].tolist()))


def extent(x: np.ndarray, c: int, q: int) -> tuple[int, int]:
    """The longest stretch around place c in which words q apart are the same."""
    def reach(step: int) -> int:
        size, at = 64, c
        while True:
            a, b = (at, min(at + size, len(x) - q)) if step > 0 else (max(0, at - size), at)
            if a >= b:
                return at
            unlike = np.flatnonzero(x[a:b] != x[a + q:b + q])
            if len(unlike):
                return a + int(unlike[0]) if step > 0 else a + int(unlike[-1]) + 1
            size, at = 2 * size, b if step > 0 else a
    return reach(-1), reach(1) + q


def primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] * (q > 1)


def least_period(x: np.ndarray, a: int, q: int) -> bool:
    """Whether no divisor of q is a period of the 2q words from a, whose period q is."""
    return not any((x[a:a + q] == x[a + q // p:a + q // p + q]).all() for p in primes(q))


def scan(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of all runs of a segment, by classes of lags."""
    width, name = 1, mixed(x.astype(np.uint64) + np.uint64(1))
    while TIMES * width <= len(x):
        name = mixed(name[:-width] * STEP + name[width:])  # of 2 * width words
        blocks = -(-len(x) // width)
        held = np.zeros(blocks * width, np.uint64)
        held[:len(name)] = name
        held = held.reshape(blocks, width)
        alike = held[1:] == held[:-1, :1]
        alike &= held[:-1, :1] != 0
        last: dict[int, int] = {}
        for block in np.flatnonzero(alike.sum(axis=1) == 1).tolist():
            c, q = block * width, width + int(np.argmax(alike[block]))
            if c + q + 2 * width <= last.get(q, 0):
                continue
            start, end = extent(x, c, q)
            last[q] = end
            if end - start >= max(LEAST, TIMES * q) and least_period(x, start, q):
                yield start, end - start, q
        width *= 2


def find(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of a text's words, by start and period."""
    with np.errstate(over="ignore"):
        return sorted({(a + start, length, q) for a, b in segments(ids) for start, length, q in scan(ids[a:b])},
                      key=lambda r: (r[0], r[2]))


def coded(words: list[bytes]) -> np.ndarray:
    codes: dict[bytes, int] = {}
    return np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run contains after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()] if runs else words)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, first, size = b.column("text").cast(pa.large_binary()), 0, 0
        found, kept = [], []
        for i, text in enumerate(texts, 1):
            words = (text.as_py() or b"").split()  # bytes part at the six blanks alone
            runs = find(coded(words)) if len(words) >= LEAST else []
            found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
            kept.append(collapsed(words, runs))
            size += len(kept[-1])
            if size > ANSWER or i == len(texts):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, i - first), pa.array(found, RUNS), pa.array(kept, pa.binary()).cast(pa.string())],
                                                 names=["doc_id", "runs", "collapsed"])
                found, kept, first, size = [], [], i, 0


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, runs (start, length, period; by start, then period) and collapsed, the text
    without the words that repeat a run's first period, joined by one space."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_runs, f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def looped(doc_id: Column, text: Column) -> Column:
    """The text, of every tenth id by its CRC-32 with words from some place on repeated with some period."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")))
    g = F.floor(h / 10).cast("long")
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BLANKS.replace("[", "[^")), F.lit(0))

    def bent(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))).cast("long")
        at = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.array_join(F.transform(at, lambda i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))), " ")
    one = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, bent(w)).otherwise(F.lit(""))), 1)
    return F.when(F.pmod(h, F.lit(10)) == 0, one).otherwise(text)


def digests(runs: DataFrame) -> DataFrame:
    """n_runs, the longest run (nulls, if there is none) and digests of all runs and of the collapsed text."""
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    length = -F.col("first.shorter")
    return runs.withColumn("first", first).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("first.start").alias("start"), length.alias("length"),
        F.col("first.period").alias("period"), F.floor(length * 1000 / F.col("first.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


ship(__name__)
