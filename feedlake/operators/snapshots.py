"""UPS-1 / STR-3: a keyed snapshot that grows - deltas merged on read, buckets that split by size.

A micro-batch writes its own rows only, as a delta. A reader takes the newest
delta row of each key and the base rows of all other keys. Base rows lie in
buckets of the key's hash: a bucket is a prefix of the 64 bits, numbered from 1
(the whole space) with 2b and 2b + 1 as the halves of b. Each bucket knows the
version up to which deltas are merged into it.

After a write, the buckets whose waiting delta rows exceed a share of their own
are compacted: read merged, split by the count just taken to prefixes of a limited
number of rows, and written anew; others stay as they are. So the work of a batch
follows the batch and the buckets that are due, never the table, and no task
writes more than a bucket. Delta and base files are sorted by hash, so a read of
some buckets prunes the others' row groups.

A key has a base row and a row of each waiting delta at most, so a merge is one
shuffle and one sort: of the rows by key for a reader, by their new buckets for a
compaction, whose count takes keys alone. The directory of buckets, which the
driver has from the manifest, is broadcast.

A version is visible once its manifest is written. The manifest of version n
names base files and deltas; a replay of n reads n - 1 (``before=n``) and
rewrites the same folders. A write of n makes later versions, of a former run
of the same input, invisible. The newest KEEP manifests and their files stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlake.operators.upsert import joined, latest_per_key, only_newer, stamped

#: Committed versions that are kept for replays.
KEEP = 3
HASH, VERSION = "_hash", "_version"
MANIFEST = "kind string, bucket long, version long, path string, n long"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path's own file system has it; any other error is raised."""
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _drop(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


@dataclass(frozen=True)
class Policy:
    """When buckets are compacted: most rows of a bucket; waiting rows, at least and as a share of a bucket's, that make
    it due; deltas after which the buckets that wait for the oldest ones are due as well."""

    limit: int = 4_000_000
    least: int = 10_000
    share: float = 0.125
    deltas: int = 24


@dataclass(frozen=True)
class Bucket:
    """A prefix of the hash space: its base folder (none while empty), rows there, version merged up to."""

    number: int
    path: str | None = None
    rows: int = 0
    upto: int = -1

    @property
    def depth(self) -> int:
        return self.number.bit_length() - 1


@dataclass(frozen=True)
class Manifest:
    buckets: tuple[Bucket, ...] = (Bucket(1),)
    deltas: tuple[tuple[int, str], ...] = ()


def _committed(spark: SparkSession, root: str) -> list[int]:
    if not exists(spark, f"{root}/_versions"):
        return []
    fs, p = _fs(spark, f"{root}/_versions")
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n) for n in names if n.isdigit() and exists(spark, f"{root}/_versions/{n}/_SUCCESS"))


def _manifest(spark: SparkSession, root: str, version: int) -> Manifest:
    """A row for each bucket and each delta that waits; the driver lists these folders to read them in any case."""
    rows = spark.read.schema(MANIFEST).json(f"{root}/_versions/{version:012d}").collect()
    return Manifest(tuple(sorted((Bucket(r["bucket"], r["path"], r["n"], r["version"]) for r in rows if r["kind"] == "base"), key=lambda b: b.number)),
                    tuple(sorted((r["version"], r["path"]) for r in rows if r["kind"] == "delta")))


def manifest(spark: SparkSession, root: str, before: int | None = None) -> Manifest | None:
    """The newest committed manifest (older than ``before`` if given)."""
    versions = [v for v in _committed(spark, root.rstrip("/")) if before is None or v < before]
    return _manifest(spark, root.rstrip("/"), versions[-1]) if versions else None


def placed(spark: SparkSession, df: DataFrame, held: Manifest) -> DataFrame:
    """``df`` with the bucket of its hash and the bucket's ``upto``: a join with the directory of all prefixes of the greatest depth."""
    depth = max(b.depth for b in held.buckets)
    first = lambda b: (b.number - (1 << b.depth)) << (depth - b.depth)
    rows = [(b.number, b.upto, first(b), first(b) + (1 << (depth - b.depth)) - 1) for b in held.buckets]
    slots = spark.createDataFrame(rows, "_bucket long, _upto long, lo long, hi long").select(
        "_bucket", "_upto", F.explode(F.sequence("lo", "hi")).alias("_slot"))
    slot = F.shiftrightunsigned(HASH, 64 - depth) if depth else F.lit(0).cast("long")
    return df.withColumn("_slot", slot).join(F.broadcast(slots), "_slot").drop("_slot")


def _waiting(spark: SparkSession, held: Manifest) -> DataFrame | None:
    """Delta rows that are not in the base yet, with their buckets."""
    if not held.deltas:
        return None
    rows = spark.read.option("mergeSchema", "true").parquet(*[p for _, p in held.deltas])
    return placed(spark, rows, held).where(F.col(VERSION) > F.col("_upto")).drop("_upto")


def _rows(spark: SparkSession, held: Manifest, numbers: list[int] | None) -> DataFrame | None:
    """Base rows and waiting delta rows of the snapshot, or of some of its buckets, with hash and version of the delta (null: base)."""
    paths = [b.path for b in held.buckets if b.path and (numbers is None or b.number in set(numbers))]
    base = spark.read.option("mergeSchema", "true").parquet(*paths).withColumn(VERSION, F.lit(None).cast("long")) if paths else None
    new = _waiting(spark, held)
    if new is None:
        return base
    new = (new if numbers is None else new.where(F.col("_bucket").isin(numbers))).drop("_bucket")
    return new if base is None else base.unionByName(new, allowMissingColumns=True)


def _newest(rows: DataFrame, by: list[str]) -> DataFrame:
    """The newest row of each key among base and delta rows; a key has few: one of the base and one of each delta."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(VERSION).desc_nulls_last()))
    return rows.withColumn("_place", place).where(F.col("_place") == 1).drop("_place", VERSION)


def _merged(spark: SparkSession, held: Manifest, keys: list[str], numbers: list[int] | None) -> DataFrame | None:
    """Rows of the snapshot, or of some of its buckets, with hash."""
    rows = _rows(spark, held, numbers)
    if rows is None:
        return None
    return _newest(rows, keys) if held.deltas else rows.drop(VERSION)


def _numbers(spark: SparkSession, held: Manifest, of: DataFrame, keys: list[str]) -> list[int]:
    """The buckets that hold the keys of ``of``: at most as many as there are."""
    if len(held.buckets) == 1:
        return [held.buckets[0].number]
    return sorted(r[0] for r in placed(spark, of.select(F.xxhash64(*keys).alias(HASH)), held).select("_bucket").distinct().collect())


def read(spark: SparkSession, root: str, keys: list[str], before: int | None = None, of: DataFrame | None = None) -> DataFrame | None:
    """The snapshot's newest committed version (older than ``before`` if given); with ``of`` only the buckets of its keys."""
    held = manifest(spark, root, before)
    if held is None:
        return None
    rows = _merged(spark, held, keys, None if of is None else _numbers(spark, held, of, keys))
    return None if rows is None else rows.drop(HASH)


def _due(held: Manifest, waiting: dict[tuple[int, int], int], policy: Policy) -> list[Bucket]:
    """Buckets to compact, by the waiting rows of each (bucket, version)."""
    count: dict[int, int] = {}
    for (number, _), n in waiting.items():
        count[number] = count.get(number, 0) + n
    late = {number for number, v in waiting if len(held.deltas) > policy.deltas and v <= held.deltas[-policy.deltas][0]}
    return [b for b in held.buckets if b.number in late or count.get(b.number, 0) >= max(policy.least, policy.share * b.rows)]


def _dealt(spark: SparkSession, rows: DataFrame, held: Manifest, n: int, keys: list[str]) -> DataFrame:
    """The newest rows, dealt by bucket and sorted by hash: the merge and the files share the shuffle and the sort."""
    dealt = placed(spark, rows, held).drop("_upto").repartition(n, "_bucket")
    return _newest(dealt, ["_bucket", HASH, *keys]).sortWithinPartitions("_bucket", HASH)


def _compact(spark: SparkSession, root: str, held: Manifest, due: list[Bucket], version: int, keys: list[str], limit: int) -> Manifest:
    """``held`` with the due buckets rewritten; a bucket with more than ``limit`` rows is split to the depth that its count asks for."""
    rows = _rows(spark, held, [b.number for b in due])
    sizes = {r[0]: r[1] for r in placed(spark, rows.select(HASH, *keys).distinct(), held).groupBy("_bucket").count().collect()}
    parts = []
    for b in due:
        more = max(0, (-(-sizes.get(b.number, 0) // limit) - 1).bit_length())
        parts += [Bucket((b.number << more) + i, upto=version) for i in range(1 << more)]
    rest = [b for b in held.buckets if b not in due]
    path = f"{root}/base/v={version:012d}"
    _dealt(spark, rows, Manifest(tuple(rest + parts)), max(1, len(parts)), keys).write.mode("overwrite").partitionBy("_bucket").parquet(path)
    written = {r[0]: r[1] for r in spark.read.parquet(path).groupBy("_bucket").count().collect()} if sizes else {}
    done = [Bucket(b.number, f"{path}/_bucket={b.number}" if b.number in written else None, written.get(b.number, 0), version) for b in parts]
    return Manifest(tuple(sorted(rest + done, key=lambda b: b.number)), held.deltas)


def write(spark: SparkSession, rows: DataFrame, root: str, version: int, keys: list[str], policy: Policy = Policy()) -> Manifest:
    """Upsert ``rows``, whole rows of unique keys, as version ``version``: a delta, then compaction of the buckets that are due."""
    root = root.rstrip("/")
    held = manifest(spark, root, version) or Manifest()
    path = f"{root}/delta/v={version:012d}"
    hashed = rows.withColumn(HASH, F.xxhash64(*keys)).withColumn(VERSION, F.lit(version).cast("long"))
    hashed.repartitionByRange(HASH).sortWithinPartitions(HASH).write.mode("overwrite").parquet(path)
    held = Manifest(held.buckets, (*held.deltas, (version, path)))
    counted = lambda m: {(r["_bucket"], r[VERSION]): r["count"] for r in _waiting(spark, m).groupBy("_bucket", VERSION).count().collect()}
    waiting = counted(held)
    if due := _due(held, waiting, policy):
        held = _compact(spark, root, held, due, version, keys, policy.limit)
        gone = {b.number for b in due}
        waiting = {k: n for k, n in waiting.items() if k[0] not in gone}
    held = Manifest(held.buckets, tuple((v, p) for v, p in held.deltas if any(w == v for _, w in waiting)))
    _commit(spark, root, version, held)
    return held


def _folders(held: Manifest) -> set[str]:
    return {b.path for b in held.buckets if b.path} | {p for _, p in held.deltas}


def _commit(spark: SparkSession, root: str, version: int, held: Manifest) -> None:
    rows = [("base", b.number, b.upto, b.path, b.rows) for b in held.buckets] + [("delta", None, v, p, None) for v, p in held.deltas]
    later = [v for v in _committed(spark, root) if v > version]
    for v in later:  # of a former run of the same input
        _drop(spark, f"{root}/_versions/{v:012d}")
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{root}/_versions/{version:012d}")
    kept = _committed(spark, root)
    named = set().union(*(_folders(_manifest(spark, root, v)) for v in kept[-KEEP:]))
    for v in kept[:-KEEP]:
        old = _folders(_manifest(spark, root, v)) - named
        _drop(spark, f"{root}/_versions/{v:012d}")
        for path in old:
            _drop(spark, path)


def upsert(spark: SparkSession, batch: DataFrame, root: str, version: int, keys: list[str], order: list[str],
           ingested_at: Column | None = None, event_time: str | None = None, transient: list[str] | None = None,
           policy: Policy = Policy()) -> Manifest:
    """UPS-1 of a batch into the stored snapshot: last write wins in ``order``, or by ``event_time`` first where one is named.

    With ``event_time`` a late row that is older than the stored one changes nothing. Fields that only the snapshot
    has survive on matched keys; ``transient`` columns of the batch are not stored.
    """
    new = latest_per_key(batch, keys, stamped(order, event_time))
    target = read(spark, root, keys, before=version, of=batch)
    if target is not None:
        new = only_newer(new, target, keys, event_time) if event_time else new
        extra = [c for c in target.columns if c not in new.columns and c != "ingested_at"]
        new = joined(new, target.select(*keys, *extra), keys, "left") if extra else new
    new = new.drop(*(transient or []))
    return write(spark, new.withColumn("ingested_at", ingested_at) if ingested_at is not None else new, root, version, keys, policy)
