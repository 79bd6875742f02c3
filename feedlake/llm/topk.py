"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are cut into 1, 4 and 16 segments; of each segment the mean and the
deviation are kept. By Cauchy and Schwarz the inner product of two segments of
length l is at most ``l m1 m2 + s1 s2``, so each resolution bounds a score from
above, that is, the distance of the vectors, lifted to one norm, from below:
``|q|^2 + M^2 - 2 bound``. Coarse to fine, candidates whose bound misses the
k-th best score known for the query are dropped; the survivors' scores are
computed exactly. Queries and candidates meet in blocks of bounded size, and
only the best k of a query leave a block.

Defined cases: a vector that is null, empty of an id, or holds a null or
non-finite component takes no part; a shorter vector counts as filled up with
zeros; of rows with one id the least vector (in Spark's array order) counts;
scores beyond the range of a long are held at its ends; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedlake.llm.common import ship, stash

K, LEVELS = 20, (1, 4, 16)
#: Rows of a block of queries and of candidates; queries that are bounded at a time.
QUERIES, CANDIDATES, BATCH = 512, 4096, 64
EXACT = 2.0 ** 53


def quantised(embedding: str, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component as double; null if the vector takes no part."""
    v = F.transform(F.col(embedding), lambda x: F.lit(scale) * x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    floor = lambda x: F.when(F.abs(x) < F.lit(EXACT), F.floor(x).cast("double")).otherwise(x)
    return F.when(~bad, F.transform(v, floor))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of each row's segments, scaled so that the inner product of two rows is the bound."""
    parts = [p for p in np.array_split(x, segments, axis=1) if p.shape[1]]
    mean = np.stack([p.mean(1) for p in parts], axis=1) if parts else np.zeros((len(x), 0))
    size = np.array([p.shape[1] for p in parts], dtype=float)
    spread = np.stack([np.sqrt(((p - p.mean(1, keepdims=True)) ** 2).sum(1)) for p in parts], axis=1) if parts else mean
    return np.hstack([mean * np.sqrt(size), spread])


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products, as float64 while those are exact, else as Python integers."""
    if not q.size or not c.size or np.abs(q).max() * np.abs(c).max() * q.shape[1] < EXACT:
        return q @ c.T
    whole = lambda m: np.vectorize(int, otypes=[object])(m)
    return np.clip(whole(q) @ whole(c).T, -(2 ** 63), 2 ** 63 - 1)


def best(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
    """(query, candidate, score) of the k best candidates of each query; ties to the smaller id."""
    order = np.argsort(cid, kind="stable")
    cid, c = cid[order], c[order]
    levels = [(statistics(q, s), statistics(c, s)) for s in LEVELS]
    for a in range(0, len(qid), BATCH):
        rows = slice(a, a + BATCH)
        ids = qid[rows]
        own = ids[:, None] == cid[None, :]
        coarse = np.where(own, -np.inf, levels[-1][0][rows] @ levels[-1][1][:, :].T) if len(cid) else np.zeros((len(ids), 0))
        least = np.full(len(ids), -np.inf)
        if len(cid) > k:
            seed = np.argpartition(coarse, -k, axis=1)[:, -k:]
            for i in range(len(ids)):
                ok = seed[i][~own[i][seed[i]]]
                if len(ok) == k:
                    least[i] = float(scores(q[rows][i:i + 1], c[ok]).min())
        left = np.arange(len(cid))
        for sq, sc in levels:
            bound = sq[rows] @ sc[left].T
            slack = 1e-6 + 1e-9 * np.abs(bound)
            left = left[((bound + slack >= least[:, None]) & ~own[:, left]).any(0)]
        exact = scores(q[rows], c[left])
        for i in range(len(ids)):
            s, at = exact[i], left
            free = ~own[i, left]
            s, at = s[free], at[free]
            if len(s) > k:
                cut = sorted(s)[-k] if s.dtype == object else np.partition(s, -k)[-k]
                s, at = s[s >= cut], at[s >= cut]
            for j in sorted(range(len(s)), key=lambda j: (-s[j], cid[at[j]]))[:k]:
                yield int(ids[i]), int(cid[at[j]]), int(s[j])


def _block(k: int):
    def run(key, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, [*queries["v"], *candidates["v"]]), default=0)
        found = list(best(queries["vec_id"].to_numpy(), matrix(queries["v"], width),
                          candidates["vec_id"].to_numpy(), matrix(candidates["v"], width), k)) if len(queries) and len(candidates) else []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows. ``is_query`` is a condition on ``vec_id``."""
    v = (vectors.select(F.col(vec_id).cast("long").alias("vec_id"), quantised(embedding).alias("v"))
         .where("vec_id IS NOT NULL AND v IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v")))
    v = stash(v, "vectors")
    queries = v.where(is_query)
    across, down = max(1, -(-queries.count() // QUERIES)), max(1, -(-v.count() // CANDIDATES))
    q = queries.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(across)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(down - 1)).cast("array<long>")).alias("cb"), "vec_id", "v")
    c = v.select(F.explode(F.sequence(F.lit(0), F.lit(across - 1)).cast("array<long>")).alias("qb"), F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(down)).alias("cb"), "vec_id", "v")
    found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInPandas(_block(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ship(__name__)

OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""
