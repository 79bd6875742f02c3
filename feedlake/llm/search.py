"""Ranked lexical search by the Best Position Algorithm.

Documents are dealt to shards of a bounded number of postings. A shard holds, for
each term of the queries, an impact list: its documents by falling impact. A
query reads its lists from the top, more of each in every round; each document
that is met is scored at once by direct access to its entries in all lists, which
also marks their places there as seen. A list's best position is the end of its
stretch of seen places from the top, however they were seen; so it lies as deep
as the last read position or deeper, and the sum of the impacts there, which no
document that was not met can exceed, falls faster. Reading stops when this sum is
strictly below the k-th best score (one as great may belong to a smaller id).
Each shard gives its k best documents a query; the k best of these are the result,
exactly.

Impacts are whole numbers (see ``impacts``). Counts and weights come from all
documents. Queries are taken in blocks of BLOCK different (item, term) pairs
(about; an item is never split), so what is sent to tasks is bounded. Terms are
compared by 64-bit hashes.

Defined cases: a null text has no terms; an item without terms, or whose terms
stand nowhere, has no rows; rows of one item count as one item with the terms of
its distinct texts together; a null item id is an item; null document ids come
after all others of equal scores, repeated ids by place in the files; an empty
table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedlake.llm.common import rows_of, scanned, ship, stash
from feedlake.llm.shingles import LOWER, chunks, utf8, words

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes that stand between terms; all bytes of other than ASCII characters are above them.
BETWEEN = np.zeros(256, dtype=bool)
BETWEEN[:128] = True
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
#: Postings of a shard, (item, term) pairs of a block of queries, places of each list that are read in the first round.
SHARD, BLOCK, READ = 1_000_000, 500_000, 16
CHUNK = 1 << 20


def terms_of(text: Column) -> Column:
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, lower), F.lit(TERM), F.lit(0))


def hashed(texts: list[str]) -> np.ndarray:
    """Hashes of single terms, as they come out within texts."""
    data, at = utf8(pa.array(texts, pa.string()))
    return words(data, at, None, BETWEEN)[0]


def _postings(vocabulary: np.ndarray):
    """Of each document the number of its terms and, of those in the sorted vocabulary, numbers and occurrences."""
    def counted(data: np.ndarray, at: np.ndarray):
        h, first = words(data, at, LOWER, BETWEEN)
        spot = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
        met = vocabulary[spot] == h if len(vocabulary) else np.zeros(len(h), bool)
        text = np.repeat(np.arange(len(at) - 1), np.diff(first))
        key, tf = np.unique(text[met] * len(vocabulary) + spot[met], return_counts=True)
        text, term = np.divmod(key, max(1, len(vocabulary)))
        return np.diff(first), np.searchsorted(text, np.arange(len(at))), term, tf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = utf8(b.column("text"))
            for i, j in chunks(at, CHUNK):
                with np.errstate(over="ignore"):
                    n, ends, term, tf = counted(data[at[i]:at[j]], at[i:j + 1] - at[i])
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column("row").slice(i, j - i), b.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))],
                    names=["row", "doc_id", "n", "term", "tf"])
    return run


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """Of occurrences in documents of n terms, of ``documents`` in all with ``length`` terms together; without the term's weight."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * n * documents // length))


class Shard:
    """Impact lists, and for direct access the same postings by document. Documents are numbered in the order of ties."""

    def __init__(self, size: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        self.ends = np.searchsorted(doc, np.arange(size + 1))
        self.term, self.impact = term, impact
        by_list = np.lexsort((doc, -impact, term))
        self.docs, self.falling = doc[by_list], impact[by_list]
        self.lists = np.searchsorted(term[by_list], np.arange(terms + 1))
        self.place = np.empty(len(doc), np.int64)  # of each posting in the table of all lists
        self.place[by_list] = np.arange(len(doc))
        self.weight = np.zeros(terms, np.int64)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, read: int = READ) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best documents with their scores, and how many were scored."""
        lo, hi = self.lists[terms], self.lists[terms + 1]
        terms, weights, lo, hi = (x[(hi > lo) & (weights > 0)] for x in (terms, weights, lo, hi))
        at, position, size = lo.copy(), lo.copy(), read
        self.weight[terms] = weights
        seen, met = np.zeros(len(self.docs), bool), np.zeros(len(self.ends) - 1, bool)
        top, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while (at < hi).any():
            upto = np.minimum(at + size, hi)
            new = np.unique(np.concatenate([self.docs[a:b] for a, b in zip(at, upto)]))
            new = new[~met[new]]
            met[new] = True
            at, size = upto, 2 * size
            if len(new):
                held = self.ends[new + 1] - self.ends[new]
                begin = np.cumsum(held) - held
                own = np.arange(held.sum()) + np.repeat(self.ends[new] - begin, held)
                worth = self.weight[self.term[own]]
                seen[self.place[own[worth > 0]]] = True
                top, score = np.concatenate([top, new]), np.concatenate([score, np.add.reduceat(worth * self.impact[own], begin)])
                order = np.lexsort((top, -score))[:k]
                top, score = top[order], score[order]
            unseen = [np.flatnonzero(~seen[p:b]) for p, b in zip(position, hi)]
            position = np.array([p + int(u[0]) if len(u) else b for p, b, u in zip(position, hi, unseen)])
            # of a list that was seen whole nothing is left; of others no more than the impact at the best position
            limit = int(np.where(position < hi, weights * self.falling[np.maximum(position - 1, lo)], 0).sum())
            if len(top) == k and limit < score[-1]:
                break
        self.weight[terms] = 0
        return top[score > 0], score[score > 0], int(met.sum())


def _search(queries: list[tuple[int, np.ndarray, np.ndarray]], terms: int, documents: int, length: int, k: int):
    """The k best documents of a shard for each (item, terms, weights)."""
    def run(group: pa.Table) -> pa.Table:
        # documents in the order of ties: by id, null last, then row
        group = group.take(pc.sort_indices(group.select(["doc_id", "row"]), [("doc_id", "ascending"), ("row", "ascending")], null_placement="at_end"))
        term = group.column("term").combine_chunks()
        doc = np.repeat(np.arange(len(group)), pc.list_value_length(term).to_numpy())
        tf = group.column("tf").combine_chunks().flatten().to_numpy().astype(np.int64)
        impact = impacts(tf, group.column("n").to_numpy()[doc], documents, length)
        shard = Shard(len(group), doc, term.flatten().to_numpy().astype(np.int64), impact, terms)
        item, at, score = [], [], []
        for number, own, weights in queries:
            top, worth, _ = shard.best(own, weights, k)
            item.append(np.full(len(top), number))
            at.append(top)
            score.append(worth)
        best = group.select(["row", "doc_id"]).take(pa.array(np.concatenate(at)))
        return pa.table({"item": pa.array(np.concatenate(item), pa.int64()), "row": best.column("row"), "doc_id": best.column("doc_id"),
                         "score": pa.array(np.concatenate(score), pa.int64())})
    return run


def _block(docs: DataFrame, pairs: pa.Table, k: int) -> DataFrame:
    """item (its number in ``pairs``), row, doc_id, score: candidates of all shards for a block of queries."""
    words_of = pairs.column("term").to_pylist()
    names = sorted(set(words_of))
    h = hashed(names)
    vocabulary = np.unique(h)
    if len(vocabulary) < len(names):
        raise ValueError("two terms of the queries have one hash")
    index = stash(docs.mapInArrow(_postings(vocabulary), "row long, doc_id long, n long, term array<int>, tf array<int>"), "search-index")
    documents, length, postings = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("term")), F.lit(0))).first()
    df = {t: c for t, c in index.select(F.explode("term").alias("term")).groupBy("term").count().collect()}  # a row for each term of the block at most
    weight = np.zeros(len(vocabulary), np.int64)
    for t, c in df.items():
        weight[t] = math.floor(1000 * math.log((2 * documents + 2) / (2 * c + 1)))
    term = dict(zip(names, np.searchsorted(vocabulary, h).tolist()))
    own: dict[int, list[tuple[int, int]]] = {}
    for item, w, times in zip(pairs.column("item").to_pylist(), words_of, pairs.column("times").to_pylist()):
        own.setdefault(item, []).append((term[w], times))
    queries = [(item, np.array([t for t, _ in x]), np.array([n * weight[t] for t, n in x])) for item, x in sorted(own.items())]
    shards = max(1, -(-postings // SHARD))
    dealt = index.where(F.size("term") > 0).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(_search(queries, len(vocabulary), documents, length, k), "item long, row long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text") -> DataFrame:
    """Each item's k best documents (of whole-number ids) with a score above 0: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    corpus = rows_of(scanned(docs), doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct()
    kind = asked.schema["item_id"].dataType.simpleString()
    pairs = stash(asked.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times")), "search-items")
    blocks = max(1, -(-pairs.count() // BLOCK))
    out = None
    for b in range(blocks):
        part = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "term").toArrow()
        own = part.column("item_id").combine_chunks()
        ids = pc.unique(own)
        item = pc.index_in(own, ids)
        found = _block(corpus, part.append_column("item", item), k)
        listed = spark.createDataFrame(pa.table({"item": pa.array(range(len(ids)), pa.int64()), "item_id": ids}), f"item long, item_id {kind}")
        w = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
        ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        ranked = ranked.join(F.broadcast(listed), "item").select("item_id", "rank", "doc_id", "score")
        ranked = ranked if blocks == 1 else stash(ranked, "search-found")
        out = ranked if out is None else out.union(ranked)
    return out


ship(__name__)

OP12_SQL = r"""
WITH tokens AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
held AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM held GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * (SELECT docs FROM whole) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held GROUP BY term),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // len))))::BIGINT AS score
           FROM asked JOIN held USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""
