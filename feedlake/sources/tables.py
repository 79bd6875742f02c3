"""Readers for the driver tables and the feeds derived from them.

The driver tables stand in for landed feed data: every derived input below is
a projection/join of them, so its size grows with the tables. Only the
columns used are selected, so parquet scans read just those columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedlake.functions import json as J
from feedlake.functions import rules as R

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def landed(records: DataFrame) -> DataFrame:
    """Raw records as they land: dealt by batch, at every size alike.

    The exchange stands where bronze storage stands in production: records are
    written by batch in one stage and parsed in the next.
    """
    n = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return records.repartition(n, "batch_id")


# Feed B is moved forward by this many days so that the three feeds overlap in time.
FEED_B_SHIFT_DAYS = 8217
FEED_C_BASE_EPOCH = 1704067200
FEED_C_STEP_SECONDS = 2590


def feed_c_ts(doc_id):
    return R.seconds_to_ntz(F.lit(FEED_C_BASE_EPOCH) + (doc_id % 1000) * FEED_C_STEP_SECONDS)


def orders_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders ⋈ customer ⋈ nation ⋈ region, columns needed by feed B only.

    nation/region are tiny dimension tables; the planner broadcasts them by its
    size check. orders ⋈ customer is a keyed (sort-merge) join at scale.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                              "o_orderdate", "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (o.join(c, o.o_custkey == c.c_custkey)
            .join(n, c.c_nationkey == n.n_nationkey)
            .join(r, n.n_regionkey == r.r_regionkey))


# ------------------------------------------------------------ canonical feeds

def listings_feed_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.lit("feed_a").alias("source"),
        F.col("event_id").cast("string").alias("external_id"),
        F.col("event_type").alias("title"),
        F.concat(F.lit("company_"), F.col("user_id").cast("string")).alias("company"),
        F.lit("Worldwide / Remote").alias("location"),
        F.concat(F.lit("https://feed-a.example/jobs/"), "event_type", F.lit("-"),
                 F.col("event_id").cast("string")).alias("url"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("salary_min"),
        F.floor(F.col("value") * 1500).cast("bigint").alias("salary_max"),
        F.lit(None).cast("boolean").alias("visa_sponsorship"),
        F.lit(True).alias("remote"),
        F.col("ts").alias("posted_at"),
    )


def listings_feed_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = orders_enriched(spark, sf_dir)
    return j.select(
        F.lit("feed_b").alias("source"),
        F.col("o_orderkey").cast("string").alias("external_id"),
        F.col("c_mktsegment").alias("title"),
        F.col("c_name").alias("company"),
        F.concat_ws(", ", "n_name", "r_name").alias("location"),
        F.concat(F.lit("https://feed-b.example/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(
            F.floor("o_totalprice").cast("bigint")).cast("bigint").alias("salary_min"),
        F.lit(None).cast("bigint").alias("salary_max"),
        F.lit(None).cast("boolean").alias("visa_sponsorship"),
        (F.col("o_orderpriority") == "1-URGENT").alias("remote"),
        F.timestamp_add("DAY", F.lit(FEED_B_SHIFT_DAYS), F.col("o_orderdate")).alias("posted_at"),
    )


def listings_feed_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return d.select(
        F.lit("feed_c").alias("source"),
        F.concat("source", F.lit("-"), F.col("doc_id").cast("string")).alias("external_id"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("company"),
        F.lit("").alias("location"),
        F.concat(F.lit("https://feed-c.example/"), F.col("doc_id").cast("string")).alias("url"),
        F.lit(None).cast("bigint").alias("salary_min"),
        F.lit(None).cast("bigint").alias("salary_max"),
        (F.col("lang") == "de").alias("visa_sponsorship"),
        (F.col("n_chars") % 2 == 0).alias("remote"),
        feed_c_ts(F.col("doc_id")).alias("posted_at"),
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored listing table: the three derived feeds, bag union (SET-1)."""
    return (listings_feed_a(spark, sf_dir)
            .unionByName(listings_feed_b(spark, sf_dir))
            .unionByName(listings_feed_c(spark, sf_dir)))


# ------------------------------------------------------------ raw JSON feeds
# Raw records are built with planted variations so that absent keys, JSON
# nulls, numeric text, floats and unparsable values all occur. The rules are
# plain moduli of the id, so the expected results can be written in SQL.

def raw_feed_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat-array feed records from ``events``: (batch_id, pos, event_id, raw)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return landed(_build_a(e))


def _build_a(e: DataFrame) -> DataFrame:
    i = F.col("event_id")
    s = lambda c: c.cast("string")
    secs = R.ntz_to_seconds(F.col("ts"))
    floor_k = F.floor(F.col("value") * 1000).cast("bigint")
    raw = J.json_record([
        ("id", F.when(i % 97 != 0, s(i))),
        ("position", F.col("event_type")),
        ("company", F.when(i % 13 != 0, F.concat(F.lit("company_"), s(F.col("user_id"))))),
        ("url", F.when(i % 3 != 2, F.concat(F.lit("https://remoteOK.com/jobs/"), s(i)))),
        ("slug", F.when(i % 3 == 0, F.concat(F.col("event_type"), F.lit("-"), s(i)))),
        ("apply_url", F.when(i % 3 == 2, F.concat(F.lit("https://apply.example/"), s(i)))),
        ("epoch", F.when(i % 4 == 0, secs).when(i % 4 == 3, F.lit(0).cast("bigint"))),
        ("epoch", F.when(i % 4 == 1, s(secs))),
        ("date", F.when(i % 4 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(i % 4 == 3, s(secs))),
        ("location", F.when(i % 7 == 0, F.lit("")).when(i % 7 == 1, F.lit("Remote EU"))),
        ("tags", F.when(i % 6 != 0, F.array("event_type", F.concat(F.lit("u"), s(F.col("user_id")))))),
        ("salary_min", F.when(i % 5 == 1, s(floor_k)).when(i % 5 == 4, s(F.col("value")))),
        ("salary_min", F.when(i % 5 == 2, floor_k)),
        ("salary_min", F.when(i % 5 == 3, F.col("value") * 1000)),
        ("salary_max", F.floor(F.col("value") * 1500).cast("bigint")),
    ], nulls=[("company", i % 13 == 0), ("salary_min", i % 5 == 0)])
    return e.select(F.floor(i / 50).cast("bigint").alias("batch_id"), (i % 50).cast("bigint").alias("pos"),
                    i.alias("event_id"), raw.alias("raw"))


def raw_feed_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursor-feed records from orders ⋈ customer ⋈ nation ⋈ region."""
    return landed(_build_b(orders_enriched(spark, sf_dir)))


def _build_b(j: DataFrame) -> DataFrame:
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    posted = F.timestamp_add("DAY", F.lit(FEED_B_SHIFT_DAYS), F.col("o_orderdate"))
    secs = R.ntz_to_seconds(posted)
    raw = J.json_record([
        ("job_id", F.when(k % 101 == 0, F.lit("")).otherwise(s(k))),
        ("job_title", F.col("c_mktsegment")),
        ("employer_name", F.when(k % 11 != 0, F.col("c_name"))),
        ("job_apply_link", F.concat(F.lit("https://feed-b.example/"), s(k))),
        ("job_location", F.when(k % 4 == 0, F.concat_ws(", ", "n_name", "r_name")).when(k % 4 == 3, F.lit(""))),
        ("job_city", F.when(k % 4 == 1, F.col("n_name"))),
        ("job_state", F.when(k % 4 == 1, F.lit(""))),
        ("job_country", F.when((k % 4 == 1) | (k % 4 == 3), F.col("r_name"))),
        ("job_is_remote", F.col("o_orderpriority") == "1-URGENT"),
        ("work_arrangement", F.when(F.col("o_orderpriority") == "2-HIGH", "remote").otherwise("onsite")),
        ("job_posted_at_datetime_utc", F.when(k % 3 == 0, F.concat(
            F.date_format(posted, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k % 3 == 2, F.lit("not-a-date"))),
        ("job_posted_at_timestamp", F.when(k % 3 != 0, secs)),
        ("job_min_salary", F.when(F.col("o_orderstatus") == "F", F.floor("o_totalprice").cast("bigint"))),
        ("job_min_salary", F.when(~F.col("o_orderstatus").isin("F", "P"), s(F.col("o_totalprice")))),
        ("job_max_salary", F.when(k % 2 == 0, F.lit(0).cast("bigint")).otherwise(
            F.floor(F.col("o_totalprice") * 1.2).cast("bigint"))),
        ("required_technologies", F.array("o_orderpriority")),
        ("preferred_technologies", F.array("c_mktsegment", F.lit(""))),
        ("job_function", F.col("c_mktsegment")),
        ("job_employment_type", F.col("o_orderstatus")),
    ], nulls=[("employer_name", k % 11 == 0), ("job_min_salary", F.col("o_orderstatus") == "P")])
    return j.select(F.floor(k / 50).cast("bigint").alias("batch_id"), (k % 50).cast("bigint").alias("pos"),
                    k.alias("o_orderkey"), raw.alias("raw"))


def raw_feed_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page-feed records from ``documents``."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return landed(_build_c(d))


def _build_c(d: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    raw = J.json_record([
        ("slug", F.when(i % 50 != 7, F.concat("source", F.lit("-"), s(i)))),
        ("title", F.concat(F.lit("doc "), s(i))),
        ("company_name", F.col("source")),
        ("url", F.concat(F.lit("https://feed-c.example/"), s(i))),
        ("location", F.when(i % 2 == 0, F.col("lang"))),
        ("tags", F.array("lang")),
        ("visa_sponsorship", F.col("lang") == "de"),
        ("four_day_week", F.when(i % 3 != 0, F.col("n_chars") % 2 == 0)),
        ("remote", F.when(i % 5 == 0, F.lit("yes"))),
        ("remote", F.when(i % 5 == 1, F.lit(0).cast("bigint"))),
        ("remote", F.when(i % 5 >= 2, F.col("n_chars") % 3 == 0)),
        ("created_at", F.lit(FEED_C_BASE_EPOCH).cast("bigint") + (i % 1000) * FEED_C_STEP_SECONDS),
    ])
    return d.select(F.floor(i / 50).cast("bigint").alias("batch_id"), (i % 50).cast("bigint").alias("pos"),
                    i.alias("doc_id"), raw.alias("raw"))


# ------------------------------------------------------------ landed payloads
# A landed payload is one JSON document per (source, batch). Batches are
# fixed-size chunks of 50 consecutive event ids, so every batch is bounded
# whatever the table size.

GATE_BATCH = 50


def gate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed-A style records from ``events`` with planted absent keys and drift."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    i = F.col("event_id")
    b = F.floor(i / GATE_BATCH).cast("bigint")
    raw = J.json_record([
        ("id", i.cast("string")),
        ("position", F.col("event_type")),
        ("company", F.when(i % 307 != 0, F.concat(F.lit("company_"), F.col("user_id").cast("string")))),
        ("url", F.when(i % 211 != 0, F.concat(F.lit("https://feed-a.example/jobs/"), i.cast("string")))),
        ("epoch", F.when(b % 23 != 4, R.ntz_to_seconds(F.col("ts")))),
    ])
    return e.select(F.lit("feed_a").alias("source"), b.alias("batch_id"), i.alias("event_id"), raw.alias("rec"))


def gate_payloads(spark: SparkSession, sf_dir: str, attempt: int = 1) -> DataFrame:
    """One payload per batch: a JSON array led by a metadata object; some batches
    are planted as an object envelope (first attempt only) or an empty array."""
    r = gate_records(spark, sf_dir)
    g = r.groupBy("source", "batch_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "rec"))), lambda x: x["rec"]),
                     ",").alias("body"))
    b = F.col("batch_id")
    payload = (F.when(b % 19 == 7, F.lit("[]"))
               .when((b % 17 == 5) & F.lit(attempt == 1), F.concat(F.lit('{"data":['), "body", F.lit("]}")))
               .otherwise(F.concat(F.lit('[{"legal":"terms"},'), "body", F.lit("]"))))
    return g.select("source", "batch_id", F.lit(attempt).cast("bigint").alias("attempt"), payload.alias("payload"))
