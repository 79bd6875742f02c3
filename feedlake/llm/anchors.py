"""Removal of repeated passages by difference-cover anchors.

A window is SPAN words of one document. Words of windows that also start in a
document with a smaller id are removed. A difference cover modulo PERIOD is a set
of residues of which every shift is a difference, so two places that begin the
same window have a common shift, under PERIOD, at which both lie on the cover.
Only grams of SPAN + 1 - PERIOD words at cover positions are hashed: two equal
windows always share an aligned anchor within them.

Anchors whose gram stands in one document only go. The others are extended: an
anchor is of the kind of all words that its windows reach (up to PERIOD - 1 on
the left, SPAN on the right). If a smaller id has the same gram and kind, all the
anchor's windows are repeated. What is left are the smallest ids of each kind;
where a gram has several kinds, their windows are hashed one by one and compared
by themselves. A document with a smaller id that has a window is the smallest of
its kind or has a smaller one of its kind, so no window is missed.

Groups of copies are aggregated (map-side first) and joined back by keys that can
be split, never held or expanded into pairs. A gram is a 64-bit hash, a kind 96
bits more, a window 128 bits. Texts are read again for the anchors' kinds and for
windows; ranges are joined to them by row number (broadcast behind a check of
their count, else shuffled).

Defined cases: null counts as no words; a null id counts as the greatest number;
rows of equal ids leave each other alone; texts under SPAN words keep all; an
empty table gives no rows; further columns are not read. A task holds the hashes
of CHUNK bytes of text, or of its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import merged, rows_of, scanned, ship, stash
from feedlake.llm.shingles import STEP, chunks, mixed, utf8, words

#: Words of a window, modulus of the cover.
SPAN, PERIOD = 50, 31
CHUNK = 1 << 19
#: Ranges, of 8 bytes each, up to which their lists are broadcast to the texts.
SMALL = 500_000
OTHER = np.uint64(0xA24BAED4963EE407)
NO_ID = (1 << 63) - 1


def cover(period: int) -> list[int]:
    """A smallest difference cover modulo ``period`` that holds 0 and 1, the first in order of its members."""
    size = 1
    while size * (size - 1) + 1 < period:
        size += 1
    while True:
        for rest in combinations(range(2, period), max(0, size - 2)):
            found = [0, 1, *rest][:size]
            if len({(a - b) % period for a in found for b in found}) == period:
                return found
        size += 1


def named(h: np.ndarray, size: int) -> np.ndarray:
    """Names of the ``size`` words from each place that has them behind it, by doubling."""
    width = 1
    while 2 * width <= size:
        h = mixed(h[:-width] * STEP + h[width:]) if len(h) > width else h[:0]
        width *= 2
    if width < size:
        rest = size - width
        h = mixed(h[:-rest] * STEP + h[rest:]) if len(h) > rest else h[:0]
    return h


def anchors(h: np.ndarray, first: np.ndarray, span: int, period: int, residues: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each anchor: text, gram, both parts of the kind, place, and first and last word behind of what its windows reach."""
    gram = named(h, span + 1 - period)
    at = np.arange(len(gram))
    text = np.searchsorted(first, at, side="right") - 1
    place = at - first[text]
    on = np.zeros(period, bool)
    on[residues] = True
    size = np.diff(first)
    good = on[place % period] & (place + span + 1 - period <= size[text]) & (size[text] >= span)
    at, text, place = at[good], text[good], place[good]
    lo, hi = np.maximum(place - period + 1, 0), np.minimum(place + span, size[text])
    reach = hi - lo >= span
    at, text, place, lo, hi = at[reach], text[reach], place[reach], lo[reach], hi[reach]
    part = 1 << ((span // 2).bit_length())  # the least power of two above half a span: pieces that overlap cover all words
    part = part if part <= span else span
    start, end = first[text] + lo, first[text] + hi
    shape = ((place - lo) * 4096 + (hi - lo)).astype(np.uint64)
    kinds = []
    for seed in (np.uint64(0), OTHER):
        piece = named(mixed(h ^ seed) if seed else h, part)
        kind = mixed(shape + seed)
        steps = -(-(span + period - 1) // part)
        for j in range(steps + 1):
            kind = mixed(kind * STEP + piece[start + (end - part - start) * j // steps])
        kinds.append(kind)
    return text, gram[at].view(np.int64), kinds[0].view(np.int64), (kinds[1] >> np.uint64(33)).astype(np.int32), place, lo, hi


def _hashed(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, at = utf8(b.column("text"))
    for i, j in chunks(at, CHUNK):
        h, first = words(data[at[i]:at[j]], at[i:j + 1] - at[i], lower=None)
        if len(h):
            yield i, j, h, first


def _grams(span: int, period: int, residues: list[int]):
    """(gram, ord) of all anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = b.column("ord").to_numpy()
            with np.errstate(over="ignore"):
                for i, j, h, first in _hashed(b):
                    text, gram, *_ = anchors(h, first, span, period, np.array(residues))
                    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(order[i:j][text])], names=["gram", "ord"])
    return run


def _anchors(span: int, period: int, residues: list[int]):
    """All anchors with their kinds; reach is the range of words that their windows cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, order = b.column("row").to_numpy(), b.column("ord").to_numpy()
            with np.errstate(over="ignore"):
                for i, j, h, first in _hashed(b):
                    text, gram, kind, more, _, lo, hi = anchors(h, first, span, period, np.array(residues))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram, kind, more, row[i:j][text], order[i:j][text], lo, (hi - lo).astype(np.int16))],
                                                     names=["gram", "kind", "more", "row", "ord", "a", "n"])
    return run


def _windows(span: int):
    """Both parts of the name of each window that starts in the ranges ``todo`` of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, order, todo = b.column("row").to_numpy(), b.column("ord").to_numpy(), b.column("todo")
            with np.errstate(over="ignore"):
                for i, j, h, first in _hashed(b):
                    one, two = named(h, span).view(np.int64), named(mixed(h ^ OTHER), span).view(np.int64)
                    starts, texts = [], []
                    for t in range(i, j):
                        for r in todo[t].as_py() or ():
                            places = np.arange(r >> 32, min(r & 0xFFFFFFFF, first[t - i + 1] - first[t - i]) - span + 1)
                            starts.append(places)
                            texts.append(np.full(len(places), t))
                    if starts:
                        start, text = np.concatenate(starts), np.concatenate(texts)
                        at = first[text - i] + start
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one[at], two[at], row[text], order[text], start)],
                                                         names=["one", "two", "row", "ord", "a"])
    return run


def packed() -> F.Column:
    """A range from a up to b in one number."""
    return F.shiftleft("a", 32) + F.col("b")


def beside(ranges: DataFrame, docs: DataFrame, name: str, how: str = "inner") -> DataFrame:
    """``docs`` with the list of each row's ranges, packed; the lists are broadcast if they hold SMALL ranges at most."""
    lists = ranges.groupBy("row").agg(F.collect_list(packed()).alias(name))
    return docs.join(F.broadcast(lists) if ranges.limit(SMALL + 1).count() <= SMALL else lists, "row", how)


def repeated(docs: DataFrame, span: int, period: int) -> DataFrame:
    """Ranges of words (row, a, b) of ``docs(row, ord, text)`` to remove, merged."""
    residues = cover(period)
    grams = docs.select("ord", "text").mapInArrow(_grams(span, period, residues), "gram long, ord long")
    shared = stash(grams.groupBy("gram").agg(F.min("ord").alias("least"), F.max("ord").alias("most")).where("least < most").select("gram"), "cover-grams")
    found = docs.mapInArrow(_anchors(span, period, residues), "gram long, kind long, more int, row long, ord long, a long, n short")
    met = stash(found.join(shared, "gram"), "cover-anchors")  # both sides plain: a hot gram can be split
    kinds = stash(met.groupBy("gram", "kind", "more").agg(F.min("ord").alias("least")), "cover-kinds")
    several = kinds.groupBy("gram").agg(F.count("*").alias("kinds")).where("kinds > 1").select("gram")
    judged = stash(met.join(kinds, ["gram", "kind", "more"]).select("gram", "row", "ord", "a", (F.col("a") + F.col("n")).alias("b"), (F.col("ord") > F.col("least")).alias("gone")),
                   "cover-judged")
    settled = judged.where("gone").select("row", "a", "b")
    edges = stash(merged(judged.where("NOT gone").join(stash(several, "cover-several"), "gram", "left_semi").select("row", "a", "b")), "cover-edges")
    names = stash(beside(edges, docs, "todo").select("row", "ord", "text", "todo").mapInArrow(_windows(span), "one long, two long, row long, ord long, a long"),
                  "cover-windows")
    least = stash(names.groupBy("one", "two").agg(F.min("ord").alias("least"), F.max("ord").alias("most")).where("least < most").select("one", "two", "least"), "cover-least")
    later = names.join(least, ["one", "two"]).where("ord > least").select("row", "a", (F.col("a") + span).alias("b"))
    return merged(settled.union(later))


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total, removed, kept = [], [], []
        for text, cuts in zip(b.column("text").cast(pa.large_binary()), b.column("cuts")):
            own, at, rest = (text.as_py() or b"").split(), 0, []  # bytes part at the six blanks alone
            for r in sorted(cuts.as_py() or ()):
                rest += own[at:r >> 32]
                at = r & 0xFFFFFFFF
            rest += own[at:]
            total.append(len(own))
            removed.append(len(own) - len(rest))
            kept.append(b" ".join(rest))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                         names=["doc_id", "n_words", "n_removed", "kept"])


def without_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, period: int = PERIOD) -> DataFrame:
    """One row per document: doc_id (a whole number), n_words, n_removed and kept, the words that stay, joined by one space."""
    rows = rows_of(scanned(docs), doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    order = rows.select("row", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("ord"), "text")
    ranges = stash(repeated(order, span, period), "cover-ranges")
    return beside(ranges, rows, "cuts", "left").select("doc_id", "text", "cuts").mapInArrow(_keep, f"doc_id {kind}, n_words long, n_removed long, kept string")


ship(__name__)
