"""Exact deduplication with a heavy-hitter split.

Digests of the normalised texts are written once. Misra-Gries summaries of k
counters, one a task, are merged to k candidates; an exact count verifies them.
The verified winners, k rows at most, are broadcast, so copies of frequent
texts are settled where they lie; only the other digests are shuffled: counted
with map-side combining, and groups joined back to their rows. A digest of more
than 2n / (k + 1) of n rows is always a winner.

Defined cases: a null text counts as empty; a null id sorts after all others;
of repeated rows with one id exactly one is kept; an empty table gives no rows;
further columns of the input are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import BLANKS, rows_of, scanned, ship, stash, without

#: Counters of a Misra-Gries summary, and so the most rows that are broadcast.
COUNTERS = 1024


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), BLANKS, " ")


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return rows_of(docs, doc_id=doc_id, text=text).select("row", "doc_id", F.unhex(F.sha2(normalised("text"), 256)).alias("digest"))


def summarise(counts: pd.Series, k: int) -> pd.Series:
    """Misra-Gries step: at most k counters, less what the (k + 1)th largest holds."""
    if len(counts) > k:
        counts = counts.sort_values(ascending=False, kind="stable")
        counts = counts.iloc[:k] - counts.iloc[k]
        counts = counts[counts > 0]
    return counts


def _counters(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.Series(dtype="int64")
        for f in frames:
            held = summarise(held.add(f["digest"].value_counts(), fill_value=0).astype("int64"), k)
        yield pd.DataFrame({"digest": held.index.to_numpy(dtype=object), "n": held.to_numpy(dtype="int64")})
    return run


def first_row() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))


def winners(table: DataFrame, k: int = COUNTERS) -> DataFrame:
    """Verified frequent digests, k at most: digest, the first row of each, its exact count."""
    candidates = (table.select("digest").mapInPandas(_counters(k), "digest binary, n long")
                  .groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(k).select("digest"))
    return (table.join(F.broadcast(candidates), "digest").groupBy("digest")
            .agg(first_row().alias("first"), F.count("*").alias("group_size")).where("group_size > 1"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = COUNTERS) -> DataFrame:
    """One row per document: row, doc_id, keep_id, group_size, kept, text_sha256."""
    table = stash(digests(scanned(docs), doc_id, text), "digests")
    frequent = stash(winners(table, k).coalesce(1), "frequent")
    marked = table.join(F.broadcast(frequent), "digest", "left")
    here = marked.where("first IS NOT NULL")
    there = marked.where("first IS NULL").select("digest", "doc_id", "row")
    groups = there.groupBy("digest").agg(first_row().alias("first"), F.count("*").alias("group_size")).where("group_size > 1")
    alone = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")  # both sides of the join plain: a hot group can be split
    there = there.join(stash(groups, "digest-groups"), "digest", "left").withColumns(
        {"first": F.coalesce("first", alone), "group_size": F.coalesce("group_size", F.lit(1))})
    return here.unionByName(there.select(*here.columns)).select(
        "row", "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("first.row") == F.col("row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, all columns."""
    docs = scanned(docs)
    return without(docs, stash(exact_dedup(docs, doc_id, text, k).where(~F.col("kept")).select("row"), "copies"))


ship(__name__)

OP3_SQL = r"""
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY digest) AS group_size,
       row_number() OVER w = 1 AS kept, digest AS text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS digest FROM documents)
WINDOW w AS (PARTITION BY digest ORDER BY doc_id NULLS LAST)
"""
