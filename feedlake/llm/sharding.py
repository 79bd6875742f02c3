"""Sharding by weighted rendezvous hashing.

Every shard bids ``-weight / ln(u)`` for a record, u being a hash of the record's
key and the shard's number in (0, 1); the highest bid wins. A further shard only
adds bids, so records move into it or stay. Slots number each shard's records
gaplessly in id order: rows are dealt by id ranges, ranges are counted per
shard, and a row's slot is its rank in the range after all earlier ranges.

Defined cases: a null key is a key of its own; a null text has size 1 and the
checksum of the empty text; repeated rows share a shard and have slots of their
own; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedlake.llm.common import stash, text_or_empty

SHARDS = 8


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The number of the winning shard."""
    text = F.coalesce(key.cast("string"), F.lit("\u0000null"))
    bids = []
    for i, weight in enumerate(weights):
        u = (F.pmod(F.xxhash64(text, F.lit(i)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        bids.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("bid"), F.lit(-i).alias("shard")))
    best = F.greatest(*bids) if len(bids) > 1 else bids[0]
    return (-best["shard"]).cast("int")


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * SHARDS,
          new_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: the shard with one more of ``new_weight``."""
    body = text_or_empty(text)
    placed = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        rendezvous(F.col(doc_id), weights).alias("shard"),
        rendezvous(F.col(doc_id), [*weights, new_weight]).alias("grown_shard"))
    placed = stash(placed, "shards")
    order = [F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranged = stash(placed.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "shard-ranges")
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("shard", "range").agg(F.count("*").alias("n"))
               .select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    rank = F.row_number().over(Window.partitionBy("shard", "range").orderBy(*order))
    return (ranged.withColumn("rank", rank).join(offsets, ["shard", "range"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard"))
