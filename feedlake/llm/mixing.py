"""Mixing sources to target weights by Pfair scheduling.

A source's documents are numbered in id order and cut into blocks. Time runs in
slots of one block. By time t a source with the exact weight w is due w t blocks;
when a source has run out, the others' weights grow in proportion, so the blocks
due add up to t throughout. The i-th block of a source has the release
floor(x) and the deadline ceil(y), x and y being the times at which i and i + 1
blocks are due; in each slot the released block with the earliest deadline runs.
This meets all deadlines, so at any time each source deviates by less than one
block from what is due, over the whole run. Nothing is rounded: times are
computed in whole numbers of any length.

Which blocks ran early in one stretch of time bears on the next, so the driver
plans the blocks' slots one after another; it holds a block of each source and
PLANNED planned ones, which it writes out. It never holds rows: their numbering
and the join with the plan are Spark's.

No row is dropped or repeated.

Defined cases: a null source is a source of its own; sources without a weight
share what is left over evenly; a weight of 0 counts as a billionth of the least
other one; null ids sort last; repeated rows are numbered each on its own; an
empty table gives no rows; further columns are kept.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedlake.llm.common import fresh, numbered as row_numbers, rows_of, scanned, sized, stash, stash_parts

#: Slots of a plan of whole shares, documents of a block, and blocks that are planned and written at a time.
SLOTS, BLOCK, PLANNED = 1000, 16, 200_000
NO_SOURCE = "\u0000none"


def shares(weights: Mapping[str, float], slots: int = SLOTS) -> dict[str, int]:
    """Whole shares of ``slots`` by largest remainder, ties to the lesser name; one at least, for which the period may grow."""
    total = sum(weights.values())
    ideal = {s: Fraction(w) * slots / Fraction(total) for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in ideal.items()}
    for s in sorted(ideal, key=lambda s: (int(ideal[s]) - ideal[s], s))[:max(0, slots - sum(out.values()))]:
        out[s] += ideal[s] >= 1
    return out


class Targets:
    """What is due of each source, by its number, at any time; exact."""

    def __init__(self, blocks: list[int], weights: list[Fraction]):
        scale = lcm(*(w.denominator for w in weights))
        self.blocks, self.weights = blocks, [int(w * scale) for w in weights]
        # of each phase, which ends when a source runs out: blocks that were due for a weight of one, blocks of sources that ran out, weight of the others
        self.level, self.out, self.rate = [], [], []
        self.last, self.phase = [0] * len(blocks), [0] * len(blocks)
        level, out, rate = Fraction(0), 0, sum(self.weights)
        for at, (end, s) in enumerate(sorted((Fraction(n, w), s) for s, (n, w) in enumerate(zip(self.blocks, self.weights)))):
            self.level.append(level)
            self.out.append(out)
            self.rate.append(rate)
            self.last[s] = at
            level, out, rate = end, out + self.blocks[s], rate - self.weights[s]

    def time(self, s: int, i: int) -> tuple[int, int]:
        """When i blocks of s are due, rounded down and up; i may not fall from call to call."""
        w, at = self.weights[s], self.phase[s]
        if at < self.last[s] and (end := self.level[at + 1]).numerator * w <= i * end.denominator:
            at = self.phase[s] = bisect_right(self.level, Fraction(i, w), hi=self.last[s] + 1) - 1
        return self.out[at] + self.rate[at] * i // w, self.out[at] - (-self.rate[at] * i // w)

    def run(self) -> Iterator[tuple[int, int, int]]:
        """(source, block, slot) in the order of slots: of the released blocks the one with the earliest deadline."""
        window = lambda s, i: (self.time(s, i)[0], self.time(s, i + 1)[1], s)
        waiting, ready, done = [window(s, 0) for s in range(len(self.blocks))], [], [0] * len(self.blocks)
        heapq.heapify(waiting)
        for slot in range(sum(self.blocks)):
            while waiting and waiting[0][0] <= slot:
                heapq.heappush(ready, heapq.heappop(waiting)[1:])
            s = heapq.heappop(ready)[1]
            yield s, done[s], slot
            done[s] += 1
            if done[s] < self.blocks[s]:
                heapq.heappush(waiting, window(s, done[s]))


def pattern(share: Mapping[str, int]) -> list[tuple[str, int, int]]:
    """(source, block, slot) of a run of ``share`` blocks of each source, which are its weights."""
    names = sorted(share)
    return [(names[s], block, slot) for s, block, slot in Targets([share[s] for s in names], [Fraction(share[s]) for s in names]).run()]


def planned(names: list[str], targets: Targets, slots: int) -> Iterator[pa.Table]:
    """source, block, slot of all blocks, ``slots`` rows at a time."""
    plan = targets.run()
    while part := list(islice(plan, slots)):
        source, block, slot = zip(*part)
        yield pa.table({"source": pa.array([names[s] for s in source]), "block": pa.array(block, pa.int64()), "slot": pa.array(slot, pa.int64())})


def numbered(docs: DataFrame, source: str, doc_id: str) -> DataFrame:
    """row, doc_id, source, at: each row's number within its source in id order, from 0.

    Rows are dealt by ranges of (source, id), so a large source fills many
    ranges; a number is the rank in the range after the counts of the earlier ones.
    """
    order = [F.col("source"), F.col("doc_id").asc_nulls_last(), F.col("row")]
    rows = rows_of(docs, doc_id=doc_id, source=source).withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)))
    ranged = stash(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "mix-ranges")
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("source", "range").agg(F.count("*").alias("n"))
               .select("source", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    rank = F.row_number().over(Window.partitionBy("source", "range").orderBy(*order[1:]))
    return (ranged.withColumn("rank", rank).join(offsets, ["source", "range"])
            .select("row", "doc_id", "source", (F.col("offset") + F.col("rank") - 1).alias("at")))


def schedule(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", doc_id: str = "doc_id",
             block: int = BLOCK, slots: int = PLANNED) -> DataFrame:
    """row (its number in ``docs``), doc_id, source, mix_slot, the slot of its block, and mix_at, its place in the block.

    Without ``weights`` the targets are the square roots of the sources' document counts.
    """
    rows = stash(numbered(docs, source, doc_id), "mix-numbers")
    counts = {r[0]: r[1] for r in rows.groupBy("source").count().collect()}
    given = {NO_SOURCE if s is None else s: w for s, w in (weights or {}).items()}
    rest = [s for s in counts if s not in given]
    target = {s: n ** 0.5 for s, n in counts.items()}
    if weights is not None:
        left = max(1e-9, 1 - sum(given[s] for s in counts if s in given)) / max(1, len(rest))
        target = {s: given.get(s, left) for s in counts}
    names = sorted(target)
    least = min((Fraction(w) for w in target.values() if w > 0), default=Fraction(1))
    targets = Targets([-(-counts[s] // block) for s in names], [Fraction(target[s]) if target[s] > 0 else least / 10**9 for s in names])
    plan = stash_parts(docs.sparkSession, planned(names, targets, slots), "source string, block long, slot long", "mix-blocks")
    return rows.withColumn("block", F.floor(F.col("at") / block)).join(sized(plan), ["source", "block"]).select(
        "row", "doc_id", F.nullif("source", F.lit(NO_SOURCE)).alias("source"), F.col("slot").alias("mix_slot"), F.pmod(F.col("at"), F.lit(block)).alias("mix_at"))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, source: str = "source", doc_id: str = "doc_id",
        block: int = BLOCK, slots: int = PLANNED) -> DataFrame:
    """``docs`` in mixed order, columns unchanged; written out, its files in name order hold the mix."""
    docs = scanned(docs)
    row, slot, at = (fresh(docs, n) for n in ("_row", "_slot", "_at"))
    plan = stash(schedule(docs, weights, source, doc_id, block, slots).select("row", "mix_slot", "mix_at").toDF(row, slot, at), "mix-plan")
    return row_numbers(docs, row).join(sized(plan), row).orderBy(slot, at).select(*docs.columns)
