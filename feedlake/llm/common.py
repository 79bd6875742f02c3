"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import re
import sys
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedlake.session import ensure_checkpoint_dir

#: The six blanks of the text rules: space, and tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Send a module's functions to executors by value, so that they need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: a table that outlives executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stash_parts(spark: SparkSession, parts: Iterable, schema: str, name: str) -> DataFrame:
    """Write tables that the driver makes one by one to one folder of the shared checkpoint folder, and read it back."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    spark.createDataFrame([], schema).write.parquet(path)
    for part in parts:
        spark.createDataFrame(part, schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def trimmed(batches: Iterator) -> Iterator:
    """The batches; after each and at the end freed memory goes back to the system, for workers outlive their stage."""
    try:
        for b in batches:
            yield b
            del b
            _trim()
    finally:
        _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of an Arrow batch, where the session names none: rows with long texts go to Python few at a time.
BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 3; fold 1 is held out. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(3))


def scrambled(v: Column) -> Column:
    """A bijection on 64-bit integers: shifts and exclusive ors only, so equal images mean equal values."""
    v = v.bitwiseXOR(F.shiftleft(v, 13))
    v = v.bitwiseXOR(F.shiftrightunsigned(v, 7))
    return v.bitwiseXOR(F.shiftleft(v, 17))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a long, b long)``: ``(node, component)``, the smallest node of each.

    Every round each vertex points to its smallest neighbour in a scrambled
    order, pointers are followed twice, and edges are rewritten to the targets;
    loops and repeats go. The scrambled order makes rising chains of ids as
    short as random ones, so the edges shrink by a constant factor a round.
    Each round is a written table. Vertices without an edge are not listed.
    """
    live = stash(edges.where("a <> b").select(scrambled(F.col("a")).alias("a"), scrambled(F.col("b")).alias("b"),
                                              F.col("a").alias("na"), F.col("b").alias("nb")), f"{name}-edges")
    nodes = stash(live.select(F.col("a").alias("v"), F.col("na").alias("node"))
                  .union(live.select("b", "nb")).distinct().withColumn("label", F.col("v")), f"{name}-nodes")
    live = live.select("a", "b")
    while not live.isEmpty():
        near = (live.union(live.select("b", "a")).groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
                .select("v", F.least("v", "m").alias("p")))
        near = stash(near, f"{name}-near")
        hop = near.select(F.col("v").alias("p"), F.col("p").alias("q"))
        to = stash(near.join(hop, "p").select("v", "q"), f"{name}-to")
        ends = lambda side: to.select(F.col("v").alias(side), F.col("q").alias(f"q{side}"))
        live = stash(live.join(ends("a"), "a").join(ends("b"), "b").where("qa <> qb")
                     .select(F.least("qa", "qb").alias("a"), F.greatest("qa", "qb").alias("b")).distinct(), f"{name}-edges")
        nodes = stash(nodes.join(to.withColumnRenamed("v", "label"), "label", "left")
                      .select("v", "node", F.coalesce("q", "label").alias("label")), f"{name}-nodes")
    least = nodes.groupBy("label").agg(F.min("node").alias("component"))
    return nodes.join(least, "label").select("node", "component")


#: Rows, of a few longs each, up to which a counted table is broadcast.
SMALL_ROWS = 1_000_000


def sized(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` (a written table) marked for broadcast if it has ``rows`` rows at most; else it is shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` if it reads Parquet files as they lie, else a written copy: rows are numbered by file and place."""
    small_batches(docs.sparkSession)
    plan = docs._jdf.queryExecution().sparkPlan().toString()
    plain = "FileScan parquet" in plan and not re.search(r"Exchange|Join|Aggregate|Window|Sample|Limit|Union|Generate|Python|Pandas|Arrow", plan)
    return docs if plain else stash(docs, "input")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or that with underscores behind it, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


#: Bits of a row's place in its file; the file's number stands above them.
PLACE = 40
#: The slashes behind the scheme of a path, which Spark writes as one or as three.
SLASHES = r":/+"


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` (scanned) with a column ``name`` that numbers its rows by file, in name order, and place in the file.

    The numbers depend on the files alone, not on how a run splits them, so they
    are alike in every job, whatever executors come and go. A file that is not
    listed, or a place that is not known, is an error and never a wrong number.
    """
    files = sorted(re.sub(SLASHES, ":/", f) for f in docs.inputFiles())
    spot, path, no = docs.metadataColumn("_metadata"), fresh(docs, "_file"), fresh(docs, "_file_no")
    listed = docs.sparkSession.createDataFrame(pa.table({path: pa.array(files, pa.string()), no: pa.array(range(len(files)), pa.int64())}))
    out = docs.withColumns({path: F.regexp_replace(spot["file_path"], SLASHES, ":/"), name: spot["row_index"]})
    out = out.join(F.broadcast(listed) if len(files) <= SMALL_ROWS else listed, path, "left")
    number = F.coalesce(F.shiftleft(no, PLACE) + F.col(name), F.raise_error(F.lit("a row of an unlisted file")).cast("long"))
    return out.withColumn(name, number).select(*docs.columns, name)


def rows_of(docs: DataFrame, **columns: str) -> DataFrame:
    """``row``, the number of each row of ``docs`` (scanned), and the columns by their new names."""
    n = fresh(docs, "_row")
    return numbered(docs, n).select(F.col(n).alias("row"), *(F.col(c).alias(new) for new, c in columns.items()))


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` (scanned) less the rows whose numbers ``gone(row)``, a written table, lists."""
    n = fresh(docs, "_row")
    return numbered(docs, n).join(sized(gone.withColumnRenamed("row", n)), n, "left_anti").drop(n)


def merged(ranges: DataFrame) -> DataFrame:
    """``ranges(row, a, b)`` of each row, from a up to b, merged where they touch or overlap."""
    w = Window.partitionBy("row").orderBy("a", "b")
    upto = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("a") <= F.col("upto"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (ranges.withColumn("upto", upto).withColumn("island", island)
            .groupBy("row", "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).select("row", "a", "b"))


ship(__name__)
