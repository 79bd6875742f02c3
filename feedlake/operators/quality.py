"""Batch quality gate: payload scan, verdicts, gate, dead letters, drift, snapshots.

All per-batch work is an aggregation keyed by ``(source, batch_id)`` with
map-side partial aggregation, so a huge batch is reduced in parallel before
its single row per batch is shuffled. Per-batch samples ("first n records")
use the records' dense position in the batch (``pos < n``), so a batch never
travels whole.
Verdict tables hold one row per batch and are joined back to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions import json as J
from feedlake.functions import text as TX

KEY = ["source", "batch_id"]
BLOCK_PAGE = "Response looks like a CAPTCHA or block page"


def python_type_name(payload: Column, readable: Column) -> Column:
    """Python type name of a JSON body ('list', 'dict', 'str', 'int', ...), read
    from the body's first character (no re-serialisation of large bodies)."""
    t = F.ltrim(payload)
    c = F.substr(t, F.lit(1), F.lit(1))
    return (F.when(~F.coalesce(readable, F.lit(False)), F.lit("str"))  # unparsable body: a text response
            .when(c == "[", F.lit("list")).when(c == "{", F.lit("dict")).when(c == '"', F.lit("str"))
            .when(c.isin("t", "f"), F.lit("bool")).when(c == "n", F.lit("NoneType"))
            .when(F.rtrim(t).rlike("[.eE]"), F.lit("float")).otherwise(F.lit("int")))


# ------------------------------------------------------------ SRC-1 scan

def scan_payloads(payloads: DataFrame, key_field: str | None = "id", payload_col: str = "payload",
                  keep: list[str] | None = None, unwrap: bool = False, pages: bool = False) -> tuple[DataFrame, DataFrame]:
    """SRC-1: JSON array payloads -> (manifest, records).

    The manifest has one row per payload (so empty batches stay visible) with
    the payload's JSON type; records are the array elements that are objects
    holding ``key_field`` (all objects when it is None), with their index in
    the kept list. The array is read as texts, one per element in its own key
    order, so its size is not bounded by that of a VARIANT; each element is
    parsed on its own. Filtering inside the array before exploding keeps indices
    dense without a window. ``unwrap`` takes ``data`` (or ``data.jobs``) of an
    object body first (SRC-4). With ``pages`` the manifest says whether a text
    response looks like a block page (VAL-5); other bodies are not searched.
    """
    keep = keep or []

    def keyed(e):
        v = J.parse(e)
        if key_field is None:
            return J.kind_of(v).startswith("OBJECT")
        # a key lookup only succeeds on an object
        return F.try_variant_get(v, f"$.{key_field}", "variant").isNotNull()

    body = F.col(payload_col)
    if unwrap:
        inner = F.coalesce(F.get_json_object(body, "$.data.jobs"), F.get_json_object(body, "$.data"))
        body = F.when(F.ltrim(body).startswith("{"), F.coalesce(inner, body)).otherwise(body)
    staged = payloads.select(*KEY, *keep, body.alias("_p"))
    array = F.ltrim("_p").startswith("[")
    staged = staged.select(*KEY, *keep, "_p", F.when(array, F.from_json("_p", "array<string>")).alias("_all"))
    readable = F.when(array, F.col("_all").isNotNull()).otherwise(J.parse("_p").isNotNull())
    kind = python_type_name(F.col("_p"), readable)
    page = [(F.when(kind == "str", TX.looks_like_block_page(F.col("_p"))).otherwise(F.lit(False))).alias("block_page")] if pages else []
    staged = staged.select(*KEY, *keep, kind.alias("payload_type"), *page,
                           F.filter("_all", lambda e: F.coalesce(F.ltrim(e).startswith("{") & keyed(e), F.lit(False))).alias("_items"))
    manifest = staged.select(*KEY, *keep, "payload_type",
                             F.coalesce(F.array_size("_items"), F.lit(0)).cast("bigint").alias("n_items"),
                             *(["block_page"] if pages else []))
    records = staged.select(*KEY, *keep, F.posexplode("_items").alias("pos", "raw")).select(
        *KEY, *keep, F.col("pos").cast("bigint").alias("pos"), "raw")
    return manifest, records


# ------------------------------------------------------------ VAL-1..4

def _set_repr(keys: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(keys, lambda k: F.concat(F.lit("'"), k, F.lit("'"))), ", "),
                    F.lit("}"))


def missing_keys(raw: Column, required: list[str]) -> Column:
    """Required keys absent from a record (presence only; a JSON null passes)."""
    keys = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    return F.array_sort(F.array_except(F.array(*[F.lit(k) for k in required]), keys))


def batch_verdicts(manifest: DataFrame, records: DataFrame, required: list[str], min_items: int = 1,
                   key: list[str] | None = None) -> DataFrame:
    """VAL-1..4: one verdict per batch; checks in order type -> count -> keys.

    ``manifest``: (source, batch_id, payload_type); ``records``: (source,
    batch_id, pos, raw). The first record (lowest pos) missing a key decides.
    ``key`` (default (source, batch_id)) may add columns, e.g. an attempt number.
    Where the manifest has ``block_page``, the reason of a body of another type says so.
    """
    key = key or KEY
    rec = records.select(*key, "pos", missing_keys(F.col("raw"), required).alias("missing"))
    agg = rec.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.array_size("missing") > 0, F.struct("pos", "missing"))).alias("first_bad"))
    page = F.col("block_page") if "block_page" in manifest.columns else F.lit(False)
    j = manifest.select(*key, "payload_type", page.alias("_page")).join(agg, key, "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    reason = (
        F.when(F.col("payload_type") != "list", F.concat(F.lit("Expected list, got "), F.col("payload_type"),
                                                         F.when(F.col("_page"), f": {BLOCK_PAGE}").otherwise(F.lit(""))))
        .when(n < min_items, F.concat(F.lit("Too few items: got "), n.cast("string"),
                                      F.lit(f", expected >= {min_items}")))
        .when(F.col("first_bad").isNotNull(),
              F.concat(F.lit("Item "), F.col("first_bad.pos").cast("string"), F.lit(" missing required keys: "),
                       _set_repr(F.col("first_bad.missing"))))
    )
    return j.select(*key, reason.isNull().alias("ok"), reason.alias("reason"),
                    F.when((F.col("payload_type") == "list") & (n >= min_items), F.col("first_bad.missing"))
                    .alias("missing"), n.cast("bigint").alias("n_items"))


# ------------------------------------------------------------ VAL-7 gate

def gate_pass(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """All-or-nothing: records of passing batches only (semi join on the batch key)."""
    return records.join(verdicts.where("ok").select(*KEY), KEY, "left_semi")


def gate_quarantine(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Records of failed batches, with the batch's reason."""
    return records.join(verdicts.where(~F.col("ok")).select(*KEY, "reason"), KEY, "inner")


def first_n(records: DataFrame, n: int, order: str = "pos", dense: bool = True) -> DataFrame:
    """WIN-4: first ``n`` records per batch.

    Records from ``scan_payloads`` carry their 0-based index in the batch, so
    the first ``n`` are simply ``pos < n``: a filter, no shuffle and no window,
    however large a batch is. For other orderings (``dense=False``) a
    ``row_number() <= n`` window is used.
    """
    if dense:
        return records.where(F.col(order) < n)
    w = Window.partitionBy(*KEY).orderBy(order)
    return records.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def dead_letters(records: DataFrame, verdicts: DataFrame, recorded_at: Column, sample: int = 3) -> DataFrame:
    """SNK-2: one dead letter per failed batch: reason, first ``sample`` raw records, details."""
    bad = verdicts.where(~F.col("ok"))
    samples = (first_n(records.join(bad.select(*KEY), KEY, "left_semi"), sample)
               .groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("_s")))
    return (bad.join(samples, KEY, "left")
            .select(*KEY, "reason",
                    F.coalesce(F.transform("_s", lambda x: x["raw"]), F.array().cast("array<string>"))
                    .alias("raw_sample"),
                    F.when(F.col("missing").isNotNull(), F.to_json(F.struct(F.col("missing").alias("missing"))))
                    .alias("details"),
                    recorded_at.alias("recorded_at")))


def resolve_attempts(verdicts: DataFrame, max_attempts: int = 2) -> DataFrame:
    """VAL-8: per batch over its attempts (1..max): first passing attempt, outcome, blocks.

    A failed first attempt counts one block and one dead letter; a second
    failure is reported as ``validation_failed_after_fallback`` only.
    """
    v = verdicts.where(F.col("attempt") <= max_attempts)
    agg = v.groupBy(*KEY).agg(
        F.min(F.when(F.col("ok"), F.col("attempt"))).alias("first_ok"),
        F.min_by("reason", "attempt").alias("first_reason"))
    return agg.select(
        *KEY, F.col("first_ok").cast("bigint").alias("accepted_attempt"),
        F.when(F.col("first_ok") == 1, F.lit("ok"))
        .when(F.col("first_ok").isNotNull(), F.lit("recovered"))
        .otherwise(F.lit("validation_failed_after_fallback")).alias("outcome"),
        F.when(F.coalesce(F.col("first_ok"), F.lit(99)) > 1, 1).otherwise(0).cast("bigint").alias("block_count"),
        F.col("first_reason").alias("first_reason"))


# ------------------------------------------------------------ VAL-6 / SNK-3

HOUSEKEEPING = ["raw", "ingested_at"]


def record_keys(records: DataFrame, raw_col: str = "raw") -> DataFrame:
    return records.withColumn("keys", F.coalesce(F.json_object_keys(raw_col), F.array().cast("array<string>")))


def schema_drift(records: DataFrame, snapshots: DataFrame, sample_size: int | None = None) -> DataFrame:
    """VAL-6: per batch, known fields absent from more than half of its records
    (of its first ``sample_size`` if given). Batches without records or without a snapshot
    are skipped. ``records`` needs a ``keys`` array; ``snapshots`` is
    (source, fields). Output: (source, batch_id, field, missing, sample_n)."""
    sample = records.select(*KEY, "pos", "keys")
    if sample_size is not None:
        sample = first_n(sample, sample_size)
    known = snapshots.where(F.array_size("fields") > 0).select("source", F.explode(F.array_distinct("fields")).alias("field"))
    # a record gives one row for each of its own keys, counted before the shuffle; fields meet batches, not records
    sizes = sample.groupBy(*KEY).agg(F.count(F.lit(1)).alias("sample_n"))
    held = sample.select(*KEY, F.explode(F.array_distinct("keys")).alias("field")).groupBy(*KEY, "field").agg(F.count(F.lit(1)).alias("held"))
    found = sizes.join(known, "source").join(held, [*KEY, "field"], "left").withColumn("missing", F.col("sample_n") - F.coalesce("held", F.lit(0)))
    return found.where(F.col("missing") * 2 > F.col("sample_n")).select(
        *KEY, "field", F.col("missing").cast("bigint").alias("missing"),
        F.col("sample_n").cast("bigint").alias("sample_n"))


def snapshot_fields(records: DataFrame) -> DataFrame:
    """SNK-3: per batch, sorted field names of its first record minus housekeeping."""
    first = records.groupBy(*KEY).agg(F.min_by("keys", "pos").alias("keys"))
    return first.select(*KEY, F.array_sort(F.array_except("keys", F.array(*[F.lit(k) for k in HOUSEKEEPING])))
                        .alias("fields"))


def latest_snapshot(per_batch: DataFrame, updated_at: Column) -> DataFrame:
    """Keyed replace: the newest batch's fields per source (one row per source)."""
    return per_batch.groupBy("source").agg(F.max_by("fields", "batch_id").alias("fields"),
                                           F.max("batch_id").alias("batch_id")).withColumn("updated_at", updated_at)


# ------------------------------------------------------------ VAL-5 / VAL-9

def block_pages(df: DataFrame, text_col: str) -> DataFrame:
    """VAL-5: flag responses that look like a CAPTCHA/block page."""
    return df.withColumn("is_block", TX.looks_like_block_page(F.col(text_col)))


def block_phrase_hits(df: DataFrame, text_col: str) -> DataFrame:
    """VAL-5: number of responses containing each block phrase (phrases with hits only)."""
    low = F.lower(F.col(text_col))
    hits = F.filter(TX.block_phrase_array(), lambda p: F.contains(low, p))
    return (df.select(F.explode(hits).alias("phrase"))
            .groupBy("phrase").agg(F.count(F.lit(1)).alias("n_hits")))


def length_check(df: DataFrame, text_col: str, min_len: int, max_len: int) -> DataFrame:
    """VAL-9: content length within the expected range."""
    n = F.length(F.col(text_col))
    return df.withColumn("length_status", F.when(n < min_len, "too_short").when(n > max_len, "too_long")
                         .otherwise("ok"))


def redirect_check(df: DataFrame, requested_col: str, final_col: str) -> DataFrame:
    """VAL-9: the final URL's host differs from the requested one."""
    a = F.lower(F.parse_url(F.col(requested_col), F.lit("HOST")))
    b = F.lower(F.parse_url(F.col(final_col), F.lit("HOST")))
    return df.withColumn("unexpected_redirect", F.coalesce(a != b, F.lit(True)))


#: Items of a quantile sketch's top level; counts up to it are kept exactly, beyond it the rank error is under 0.1 %.
SKETCH = 4096


def size_sketches(sizes: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """VAL-9: a quantile sketch of each measure per group; sketches of parts merge (``merge_sketches``)."""
    return sizes.groupBy(*by).agg(*[F.kll_sketch_agg_bigint(m, SKETCH).alias(m) for m in measures])


def merge_sketches(sketches: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """One sketch per group and measure from those of several batches."""
    return sketches.groupBy(*by).agg(*[F.kll_merge_agg_bigint(m, SKETCH).alias(m) for m in measures])


def learned_range_check(sizes: DataFrame, sketches: DataFrame, by: list[str], measures: list[str], low: float = 0.01,
                        high: float = 0.99, slack: float = 2.0) -> DataFrame:
    """VAL-9: each response's measures against the range that its group's history has shown.

    The range runs from the ``low`` quantile divided by ``slack`` to the ``high`` one times ``slack``. A group without
    history has status ``unknown``. Only sketches, a row for each group, are joined to the responses.
    """
    at = lambda m, q: F.kll_sketch_get_quantile_bigint(F.col(f"_{m}"), F.lit(q))
    learned = sketches.select(*by, *[F.col(m).alias(f"_{m}") for m in measures]).select(
        *by, *[c for m in measures for c in ((at(m, low) / slack).alias(f"_{m}_low"), (at(m, high) * slack).alias(f"_{m}_high"))])
    status = lambda m: (F.when(F.col(f"_{m}_low").isNull(), "unknown").when(F.col(m) < F.col(f"_{m}_low"), "too_few")
                        .when(F.col(m) > F.col(f"_{m}_high"), "too_many").otherwise("ok"))
    return sizes.join(learned, by, "left").select(*sizes.columns, *[status(m).alias(f"{m}_status") for m in measures])
