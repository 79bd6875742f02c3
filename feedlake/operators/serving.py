"""Serving views over the stored listings: filters, newest-first, pages, cards.

Top-k queries are expressed as ``orderBy(...).limit(k)`` so the planner uses
a per-partition top-k followed by a merge of k rows per partition
(TakeOrderedAndProject) instead of a full sort. Pages use ``offset`` on top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from feedlake.functions import rules as R

SERVED_LIMIT_DEFAULT = 200
SERVED_LIMIT_MAX = 1000
ITEMS_PER_PAGE = 8


def newest_first() -> list[Column]:
    """SRT-1 order: newest first, NULL dates last, then a unique tie-break."""
    return [F.desc_nulls_last("posted_at"), F.asc("source"), F.asc("external_id")]


def served(df: DataFrame) -> DataFrame:
    """NRM-F: serving projection (no raw record)."""
    return df.drop("raw") if "raw" in df.columns else df


def check_limit(limit: int) -> int:
    if not isinstance(limit, int) or limit < 1 or limit > SERVED_LIMIT_MAX:
        raise ValueError(f"limit must be in 1..{SERVED_LIMIT_MAX}, got {limit!r}")
    return limit


def latest(df: DataFrame, source: str | None = None, limit: int = SERVED_LIMIT_DEFAULT) -> DataFrame:
    """SRC-5 + FLT-2 + SRT-1: optional source filter, newest first, head ``limit``."""
    check_limit(limit)
    if source is not None:
        df = df.where(F.col("source") == F.lit(source))
    return served(df).orderBy(*newest_first()).limit(limit)


# ------------------------------------------------------------ filter chips

def by_source(df: DataFrame, source: str) -> DataFrame:
    """FLT-2."""
    return df.where(F.col("source") == F.lit(source))


def remote_only(df: DataFrame) -> DataFrame:
    """FLT-3: ``remote === true`` (NULL drops)."""
    return df.where(F.col("remote") == F.lit(True))


def with_salary(df: DataFrame) -> DataFrame:
    """FLT-4: ``salary_min !== null`` (0 passes)."""
    return df.where(F.col("salary_min").isNotNull())


def visa(df: DataFrame) -> DataFrame:
    """FLT-5: visa sponsorship offered."""
    return df.where(F.col("visa_sponsorship") == F.lit(True))


def displayable(df: DataFrame) -> DataFrame:
    """FLT-6: title, company and url all non-empty."""
    ok = F.lit(True)
    for c in ("title", "company", "url"):
        ok = ok & F.coalesce(F.length(F.col(c)) > 0, F.lit(False))
    return df.where(ok)


def filter_predicate(name: str) -> Column:
    """The predicate of a named filter chip (a source name filters by source)."""
    if name == "all":
        return F.lit(True)
    if name == "remote":
        return F.coalesce(F.col("remote") == F.lit(True), F.lit(False))
    if name == "salary":
        return F.col("salary_min").isNotNull()
    if name == "visa":
        return F.coalesce(F.col("visa_sponsorship") == F.lit(True), F.lit(False))
    return F.coalesce(F.col("source") == F.lit(name), F.lit(False))


# ------------------------------------------------------------ paging

def page_summary(df: DataFrame, filters: list[str], per_page: int = ITEMS_PER_PAGE) -> DataFrame:
    """AGG-8: per filter, the total and ``max(1, ceil(n / per_page))`` pages; one scan."""
    agg = df.agg(*[F.count_if(filter_predicate(f)).alias(f"n{i}") for i, f in enumerate(filters)])
    stack = ", ".join(f"'{f}', n{i}" for i, f in enumerate(filters))
    out = agg.selectExpr(f"stack({len(filters)}, {stack}) as (filter, total_items)")
    return out.select("filter", F.col("total_items").cast("bigint").alias("total_items"),
                      F.greatest(F.lit(1), F.ceil(F.col("total_items") / F.lit(per_page))).cast("bigint")
                      .alias("total_pages"))


def page_slice(df: DataFrame, page: int, total_items: int, per_page: int = ITEMS_PER_PAGE,
               order: list[Column] | None = None) -> DataFrame:
    """WIN-1: items ``[(p-1)*per_page, p*per_page)`` of the ordered rows, the page
    clamped to ``1..max(1, ceil(total/per_page))``. A bounded top-k plus offset."""
    pages = max(1, -(-total_items // per_page))
    p = min(max(page, 1), pages)
    ordered = df.orderBy(*(order or newest_first()))
    return (ordered.limit(p * per_page).offset((p - 1) * per_page)
            .withColumn("page", F.lit(p).cast("bigint")))


def store_ranked(df: DataFrame, path: str, ranges: int, order: list[Column] | None = None) -> None:
    """WIN-1 for deep pages: ``df`` written in ranges of the serving order, and an index of their counts (a row for each range).

    One range sort; a range is one partition folder, so a page reads only the folders that hold it.
    """
    order = order or newest_first()
    (df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()).sortWithinPartitions(*order)
     .write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows"))
    df.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")
    counts = _ranked_rows(df.sparkSession, path).groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts.withColumn("before", before).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def _ranked_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/schema").schema.add("_range", IntegerType())).parquet(f"{path}/rows")


def stored_page(spark: SparkSession, path: str, page: int, per_page: int = ITEMS_PER_PAGE, order: list[Column] | None = None) -> DataFrame:
    """WIN-1: a page of a ``store_ranked`` table, clamped like ``page_slice``; only the ranges that hold it are read.

    The index names them: at most as many as a page has rows come to the driver, and the total.
    """
    index = spark.read.parquet(f"{path}/index")
    total = index.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    p = min(max(page, 1), max(1, -(-total // per_page)))
    lo, hi = (p - 1) * per_page, p * per_page
    holds = sorted((r["_range"], r["before"]) for r in index.where((F.col("before") < hi) & (F.col("before") + F.col("n") > lo)).collect())
    rows = _ranked_rows(spark, path).where(F.col("_range").isin([r for r, _ in holds])).drop("_range")
    skipped = holds[0][1] if holds else 0
    return (rows.orderBy(*(order or newest_first())).limit(hi - skipped).offset(lo - skipped).withColumn("page", F.lit(p).cast("bigint")))


# ------------------------------------------------------------ cards

def cards(df: DataFrame, as_of: Column, primary_source: str = "feed_a", primary_label: str = "Feed A",
          other_label: str = "Feed B", slug_site: str = "https://feed-a.example/jobs/") -> DataFrame:
    """NRM-G: display card per listing (labels, salary text, relative time, tags, id)."""
    is_primary = F.col("source") == F.lit(primary_source)
    ingested = F.col("ingested_at") if "ingested_at" in df.columns else F.lit(None).cast("timestamp_ntz")
    tags = F.col("tags") if "tags" in df.columns else F.array().cast("array<string>")
    url_ok = F.coalesce(F.length("url") > 0, F.lit(False))
    return df.select(
        "source", "external_id",
        F.when(is_primary, F.lit(primary_label)).otherwise(F.lit(other_label)).alias("source_label"),
        F.col("company"), F.col("title"),
        F.when(F.coalesce(F.length("location") > 0, F.lit(False)), F.col("location"))
        .otherwise(F.lit("Worldwide / Remote")).alias("location_label"),
        F.coalesce(F.col("remote"), F.lit(False)).alias("remote_pill"),
        R.salary_label(F.col("salary_min"), F.col("salary_max")).alias("salary_text"),
        R.relative_time(F.col("posted_at"), ingested, as_of).alias("posted_label"),
        F.concat_ws(" ", F.transform(F.slice(F.coalesce(tags, F.array().cast("array<string>")), 1, 5),
                                     lambda t: F.concat(F.lit("#"), t))).alias("tag_text"),
        F.substring(F.col("external_id"), 1, 20).alias("id_text"),
        F.when(url_ok, F.col("url")).otherwise(F.concat(F.lit(slug_site), F.col("external_id"))).alias("apply_url"),
        F.when(is_primary, F.lit(f"View on {primary_label}"))
        .otherwise(F.concat(F.lit("Apply at "), F.col("company"))).alias("apply_label"),
    )


# ------------------------------------------------------------ fail-over reads

def failover_union(feeds: list[tuple[int, DataFrame, str]], limit: int, source: str | None = None) -> DataFrame:
    """SRC-10: feeds read directly in priority order, concatenated (arrival order
    within a feed), optionally one source only, head ``limit``.

    ``feeds``: (priority, frame, arrival-order column). A bounded top-k over
    (priority, arrival position), no full sort.
    """
    check_limit(limit)
    parts = None
    for prio, df, pos in feeds:
        part = served(df).withColumn("_prio", F.lit(prio)).withColumn("_pos", F.col(pos))
        parts = part if parts is None else parts.unionByName(part)
    if source is not None:
        parts = parts.where(F.col("source") == F.lit(source))
    return parts.orderBy("_prio", "_pos").limit(limit).drop("_prio", "_pos")


def fallback_if_empty(primary: DataFrame, backup: DataFrame) -> DataFrame:
    """SRC-11: ``primary`` when it has rows, otherwise ``backup``.

    Decided inside the plan: the backup is anti-joined on a constant key with
    at most one row of the primary (``limit(1)``), so no count reaches the
    driver; the join holds one row on that side.
    """
    probe = primary.select(F.lit(1).alias("_k")).limit(1)
    gated = backup.withColumn("_k", F.lit(1)).join(probe, "_k", "left_anti").drop("_k")
    return primary.unionByName(gated)
