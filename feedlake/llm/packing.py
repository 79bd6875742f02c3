"""Conflict-constrained best-fit packing.

Documents are packed into bins of a fixed number of bytes, in pools that follow
the order of the input: a pool is a stretch of rows of one input file, so pools
are bounded, independent and keep the mix that the order holds. Within a pool,
documents go largest first. Open bins are ordered by what they have left; the
search starts at the tightest bin that can hold the document and goes on to its
successors until one is compatible: a bin carries bitmaps of its sources and of
its duplicate clusters, and takes no further document of a source that it holds
SOURCE_SHARE times or of a cluster that it holds. If none fits, a bin is opened.

A document larger than a bin is cut into pieces; full pieces fill bins of their
own and the last is packed like a document. Only sizes, sources and clusters go
to the packing tasks, never texts. A cluster is the least shingle hash (five
words) of a document, so documents that share much text mostly share it.

Defined cases: null and empty texts have size 0 and are packed (into any
compatible bin); a null source is a source of its own; documents without words
are in no cluster; repeated rows share a cluster, so they part; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import ship, stash, trimmed
from feedlake.llm.shingles import sets_of

#: Bytes of a bin, documents of one source in a bin, rows of a pool.
CAPACITY, SOURCE_SHARE, POOL = 16384, 4, 4096
#: Bits of a bitmap; two names may share a bit, which only keeps documents apart.
BITS = 4096


class Bins:
    """Open bins of one pool, ordered by (residual, number)."""

    def __init__(self, capacity: int, share: int):
        self.capacity, self.share = capacity, share
        self.order: list[tuple[int, int]] = []
        self.full_sources: list[int] = []
        self.clusters: list[int] = []
        self.held: list[dict[int, int]] = []

    def open(self, left: int) -> int:
        self.full_sources.append(0)
        self.clusters.append(0)
        self.held.append({})
        insort(self.order, (left, len(self.held) - 1))
        return len(self.held) - 1

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """The bin and the offset in it."""
        s, c = 1 << source, (1 << cluster) if cluster >= 0 else 0
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            b = self.order[at][1]
            if not self.full_sources[b] & s and not self.clusters[b] & c:
                break
            at += 1
        if at == len(self.order):
            b = self.open(self.capacity)
            at = bisect_left(self.order, (self.capacity, b))
        left, b = self.order.pop(at)
        self.clusters[b] |= c
        self.held[b][source] = self.held[b].get(source, 0) + 1
        if self.held[b][source] >= self.share:
            self.full_sources[b] |= s
        if left > size:
            insort(self.order, (left - size, b))
        elif size == 0:
            insort(self.order, (left, b))
        return b, self.capacity - left


def _pack(capacity: int, share: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "at"], ascending=[False, True], kind="stable")
        bins, out = Bins(capacity, share), []
        for row in pdf.itertuples(index=False):
            whole, last = divmod(row.size, capacity)
            if whole and not last:
                whole, last = whole - 1, capacity
            for i in range(whole):
                b, offset = len(bins.held), 0
                bins.full_sources.append(0)
                bins.clusters.append(0)
                bins.held.append({})
                out.append((row.pool, row.at, row.doc_id, row.source_name, row.cluster, row.bit, i, b, offset, capacity))
            b, offset = bins.place(last, row.source, row.bit)
            out.append((row.pool, row.at, row.doc_id, row.source_name, row.cluster, row.bit, whole, b, offset, last))
        return pd.DataFrame(out, columns=["pool", "at", "doc_id", "source", "cluster", "bit", "piece", "bin", "offset", "size"])
    return run


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in trimmed(batches):
        least = [int(s[0]) if len(s) else None for s in sets_of(b.column("text"), 5)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("pool", "at", "doc_id", "source", "size")), pa.array(least, pa.int64())],
                                         names=["pool", "at", "doc_id", "source", "size", "cluster"])


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY,
         share: int = SOURCE_SHARE, pool: int = POOL) -> DataFrame:
    """One row per piece: doc_id, source, cluster, piece, bin_id, bin_offset, piece_bytes.

    ``docs`` must be a table read from files, whose rows' places are the order; anything else is written first.
    """
    if not docs.inputFiles():
        docs = stash(docs, "pack-input")
    kind = docs.schema[doc_id].dataType.simpleString()
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    rows = docs.select(F.concat_ws(":", name, F.floor(row / pool)).alias("pool"), row.alias("at"), F.col(doc_id).alias("doc_id"),
                       F.col(source).cast("string").alias("source"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("size"),
                       F.col(text).alias("text"))
    items = rows.mapInArrow(_items, f"pool string, at long, doc_id {kind}, source string, size long, cluster long")
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS)).cast("int")
    # no nulls among the clusters that go to pandas, which would make floats of them
    items = items.select("pool", "at", "doc_id", F.col("source").alias("source_name"), F.coalesce("cluster", F.lit(0)).alias("cluster"), "size", bit("source").alias("source"),
                         F.when(F.col("cluster").isNull(), -1).otherwise(bit("cluster")).alias("bit"))
    packed = items.groupBy("pool").applyInPandas(_pack(capacity, share), f"pool string, at long, doc_id {kind}, source string, "
                                                 "cluster long, bit int, piece int, bin int, offset long, size long")
    return packed.select("doc_id", "source", F.when(F.col("bit") >= 0, F.col("cluster")).alias("cluster"), "piece", F.concat_ws("#", "pool", "bin").alias("bin_id"),
                         F.col("offset").alias("bin_offset"), F.col("size").alias("piece_bytes"))


ship(__name__)
