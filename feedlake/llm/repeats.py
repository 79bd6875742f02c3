"""Removal of repeated byte strings by bucket-pointer refinement over sampled suffixes.

Every string of SPAN bytes that starts at two places is removed at all of them.
Bucket identifiers of 8 bytes at every place are doubled to 16, 32, 64 and 128
by pairing a place's identifier with the one at the later offset, each update
serving the next. Suffixes are sampled at anchors: the place of the least 32-byte
identifier (leftmost of equals) in a SPAN-byte string, its own choice alone, so
equal strings have equal anchors at equal distances. An anchor stands for the
run of strings that chose it.

Initial buckets hold the anchors of one 32-byte gram; a bucket of one is unique
and goes. Buckets are refined by identifiers at further offsets: an anchor whose
whole run (all bytes of its strings) is in a bucket with another is repeated
throughout. Where a bucket parts, its runs are cut into stretches of 64, then 16,
then single strings. The bytes common to a stretch's strings bucket it anew: alone in
a bucket it goes; bytes of all its strings shared with another settle it; one of
each settled kind stays as evidence for the rest. So only the edges of repeats
are ever looked at string by string, and no bucket is expanded into pairs.
What is removed is alike in two independent 64-bit identifiers of all its bytes;
a collision in a gram or a stretch's common bytes only costs a further look.

Texts stay where they lie: the stretches to look at, and at last the byte ranges
to remove, are joined to them by row number (broadcast behind a check of their
count, else shuffled).

Defined cases: null counts as empty; texts under SPAN bytes keep all; repeated
rows repeat each other; an empty table gives no rows; further columns are not
read. A task holds the identifiers of CHUNK bytes, or of its longest text.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import merged, rows_of, scanned, ship, stash
from feedlake.llm.shingles import STEP, chunks, mixed, utf8

SPAN, GRAM = 200, 32
#: Places of a gram in a string, and stretches of strings by round.
PLACES, STRETCHES = SPAN - GRAM + 1, (64, 16, 1)
CHUNK = 1 << 19
#: Stretches, or ranges, up to which they are broadcast to the texts.
SMALL = 2_000_000
#: Multiplier of the second family of identifiers.
SECOND = np.uint64(0xD6E8FEB86659FD93)
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place as a number; past the end there are zero bytes."""
    d = np.concatenate([data, np.zeros(256, np.uint8)]).astype(np.uint64)
    for h in (1, 2, 4):
        d = d[:-h] | (d[h:] << np.uint64(8 * h))
    return d


def pointers(d: np.ndarray, n: int, step: np.uint64 = STEP) -> dict[int, np.ndarray]:
    """Bucket identifiers of 32 and 128 bytes at the first ``n`` places, by doubling ``eights``; each ``step`` gives a family of its own."""
    out = {}
    for h in (8, 16, 32, 64):
        d = mixed(d[:-h] * step + d[h:])
        out[2 * h] = d
    return {32: out[32][:n], 128: out[128][:n]}


def spanned(far: np.ndarray, lo: np.ndarray, p: np.ndarray, hi: np.ndarray, step: np.uint64 = STEP) -> np.ndarray:
    """Identifiers of all bytes of the runs from the strings at ``lo`` to those at ``hi``, by their anchors' places in them too."""
    span = SPAN - 128
    whole = mixed(mixed(far[lo] * step + far[np.minimum(lo + 128, hi + span)]) * step + far[hi + span])
    return mixed(whole * step + ((p - lo) * 1024 + (hi - lo)).astype(np.uint64)).view(np.int64)


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each run: row, gram, two identifiers of all its bytes, first string, anchor and last string within the text."""
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none, none, none, none, none, none, none
    d = eights(data)
    ids = pointers(d, len(data))
    least = (ids[32] & HIGH) | np.arange(len(data), dtype=np.uint64)
    width = 1
    while 2 * width <= PLACES:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = PLACES - width
    least = np.minimum(least[:len(least) - rest], least[rest:]) if rest else least
    size = np.diff(at)
    row = np.repeat(np.arange(len(size)), np.maximum(0, size - SPAN + 1))
    if not len(row):
        return none, none, none, none, none, none, none
    start = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(0, size - SPAN + 1)) - np.maximum(0, size - SPAN + 1), np.maximum(0, size - SPAN + 1)) + at[row]
    anchor = (least[start] & LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
    last = np.concatenate([first[1:], [len(row)]]) - 1
    lo, hi, p, row = start[first], start[last], anchor[first], row[first]
    whole, check = spanned(ids[128], lo, p, hi), spanned(pointers(d, len(data), SECOND)[128], lo, p, hi, SECOND)
    return row, ids[32][p].view(np.int64), whole, check, lo - at[row], p - at[row], hi - at[row]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names, (data, at) = b.column("row").to_numpy(), utf8(b.column("text"))
        for i, j in chunks(at, CHUNK):
            with np.errstate(over="ignore"):
                row, gram, whole, check, lo, p, hi = anchors(data[at[i]:at[j]], at[i:j + 1] - at[i])
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[i:j][row]), pa.array(gram), pa.array(whole), pa.array(check), pa.array(p.astype(np.int32)),
                     pa.array((p - hi).astype(np.int16)), pa.array((p - lo).astype(np.int16))],
                    names=["row", "gram", "whole", "check", "p", "near", "far"])


def bucket(data: bytes) -> tuple[int, int]:
    """Two independent identifiers."""
    return struct.unpack("<qq", hashlib.blake2b(data, digest_size=16).digest())


def _stretches(step: int):
    """Of each stretch its place in the text and the buckets of its common and of all its bytes.

    A stretch comes as anchor, nearest and farthest string of its run, nearest of the stretch, evidence.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[int]] = [[] for _ in range(9)]
            for row, text, todo in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), b.column("todo").to_pylist()):
                data = (text or "").encode()
                for t in todo:
                    p, near, far, base, width, seen = t["p"], t["near"], t["far"], t["base"], t["width"], t["seen"]
                    gram = data[p:p + GRAM]
                    for d0 in range(base, base + width, step):
                        d1 = d0 + step - 1
                        if d0 > far or d1 < near:
                            continue
                        common, _ = bucket(gram + b"%d:%d:" % (step, d0) + data[p - d0:p - d1 + SPAN])
                        inside = p - d1 >= 0 and p - d0 + SPAN <= len(data)
                        whole, check = bucket(b"%d:" % d0 + gram + data[p - d1:p - d0 + SPAN]) if inside else bucket(b"%d:%d:%d" % (row, p, d0))
                        for o, v in zip(out, (row, p, near, far, d0, seen, common, whole, check)):
                            o.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int16(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()))],
                names=["row", "p", "near", "far", "base", "seen", "common", "whole", "check"])
    return run


NODE = "row long, p int, near short, far short, base short, seen boolean, common long, whole long, check long"


def beside(rows: DataFrame, each: DataFrame, docs: DataFrame, how: str = "inner") -> DataFrame:
    """``docs`` with each row's list; the lists are broadcast if they hold SMALL entries at most."""
    return docs.join(F.broadcast(rows) if each.limit(SMALL + 1).count() <= SMALL else rows, "row", how)


def split(nodes: DataFrame, bucket_of: str, step: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(settled ranges, stretches that go on): buckets of one go, kinds of two or more are settled,
    and of buckets with several kinds one of each goes on. A kind is both identifiers of all bytes."""
    ends = [f("whole" if k < 2 else "check").alias(f"k{k}") for k, f in enumerate((F.min, F.max, F.min, F.max))]
    sizes = nodes.groupBy(bucket_of).agg(F.count("*").alias("n"), *ends).where("n > 1").select(
        bucket_of, ((F.col("k0") != F.col("k1")) | (F.col("k2") != F.col("k3"))).alias("several"))
    shared = nodes.join(stash(sizes, f"{name}-sizes"), bucket_of)  # both sides plain: a hot bucket can be split
    kind, several = ["whole", "check"], F.col("several")
    one = shared.where(~several)
    some = stash(shared.where(several), f"{name}-several")
    kinds = some.groupBy(*kind).agg(F.count("*").alias("m"), F.min(F.struct("row", "p")).alias("first"))
    some = some.join(stash(kinds, f"{name}-kinds"), kind)
    near, far = F.greatest("near", "base"), F.least(F.col("far"), F.col("base") + step - 1)
    done = lambda df: df.where(~F.col("seen")).select("row", (F.col("p") - far).alias("a"), (F.col("p") - near + SPAN).alias("b"))
    settled = done(one).union(done(some.where("m > 1")))
    onward = some.where((F.col("m") == 1) | ((F.col("first.row") == F.col("row")) & (F.col("first.p") == F.col("p")))).select(
        "row", "p", "near", "far", "base", F.lit(step).alias("width"), (F.col("seen") | (F.col("m") > 1)).alias("seen"))
    return stash(settled, f"{name}-settled"), stash(onward, f"{name}-onward")


def repeated(docs: DataFrame) -> DataFrame:
    """Byte ranges (row, a, b) to remove, merged and apart from each other."""
    found = stash(docs.mapInArrow(_anchors, "row long, gram long, whole long, check long, p int, near short, far short"), "repeat-anchors")
    runs = found.withColumns({"base": F.lit(0).cast("short"), "seen": F.lit(False)})
    settled, onward = split(runs, "gram", 192, "repeat-runs")
    for step in STRETCHES:
        todo = onward.groupBy("row").agg(F.collect_list(F.struct("p", "near", "far", "base", "width", "seen")).alias("todo"))
        nodes = stash(beside(todo, onward, docs).select("row", "text", "todo").mapInArrow(_stretches(step), NODE), f"repeat-{step}")
        more, onward = split(nodes, "common", step, f"repeat-{step}")
        settled = settled.union(more)
    return merged(settled)


def _remove(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, removed, spans, kept, left = [], [], [], [], []
            for text, cuts in zip(b.column("text").to_pylist(), b.column("cuts").to_pylist()):
                data, at, rest = (text or "").encode(), 0, []
                for a, z in sorted((c["a"], c["b"]) for c in cuts or []):
                    rest.append(data[at:a])
                    at = z
                rest = b"".join([*rest, data[at:]])
                size.append(len(data))
                removed.append(len(data) - len(rest))
                spans.append(len(cuts or []))
                kept.append(hashlib.sha256(rest).hexdigest())
                left.append(rest)
            own = [pa.array(kept, pa.string())] if kind == "digest" else [pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), *own],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if kind == "digest" else "kept"])
    return run


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", kind: str = "digest") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256 (or, of kind "bytes", kept)."""
    rows = rows_of(scanned(docs), doc_id=doc_id, text=text)
    ranges = stash(repeated(rows.select("row", "text")), "repeat-ranges")
    cuts = ranges.groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("cuts"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    last = "kept_sha256 string" if kind == "digest" else "kept binary"
    return beside(cuts, ranges, rows, "left").select("doc_id", "text", "cuts").mapInArrow(
        _remove(kind), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, {last}")


ship(__name__)
