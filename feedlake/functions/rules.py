"""Scalar column rules shared by the normalisers and the serving views.

Each function returns a Column expression; nothing here runs Python per row,
so all of it stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlake.functions import json as J

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
# Largest epoch second a Python datetime accepts (year 9999).
MAX_EPOCH_SECONDS = 253402300799


def epoch_ntz() -> Column:
    return F.expr(EPOCH_NTZ)


def seconds_to_ntz(secs: Column) -> Column:
    """Epoch seconds -> TIMESTAMP_NTZ in UTC, independent of the session time zone.

    Out-of-range values give NULL (Python raises and the reference keeps None).
    """
    s = secs.cast("bigint")
    return F.when(F.abs(s) <= MAX_EPOCH_SECONDS, F.timestamp_add("SECOND", s, epoch_ntz()))


def micros_to_ntz(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros.cast("bigint"), epoch_ntz())


def ntz_to_seconds(ts: Column) -> Column:
    """TIMESTAMP_NTZ (UTC wall clock) -> epoch seconds as BIGINT (floor)."""
    return F.floor(F.timestamp_diff("MICROSECOND", epoch_ntz(), ts) / F.lit(1000000)).cast("bigint")


# ---------------------------------------------------------------- coercions

_INT_TEXT = r"^\s*[+-]?\d+\s*$"
_FLOAT_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def python_int(x: Column) -> Column:
    """``int(v)`` for a JSON value, NULL where Python raises (F-2a).

    Integers pass, floats truncate toward zero, booleans give 1/0, numeric
    text with an integer literal passes (``' 12 '`` -> 12, ``'12.5'`` -> NULL).
    """
    t = J.vtype(x)
    s = J.as_string(x)
    return (
        F.when(J.is_null_or_absent(x), F.lit(None).cast("bigint"))
        .when(t == "BOOLEAN", F.when(F.try_variant_get(x, "$", "boolean"), 1).otherwise(0).cast("bigint"))
        .when(t == "STRING", F.when(s.rlike(_INT_TEXT), F.trim(s).try_cast("bigint")))
        .when(J.is_numeric(x), F.try_variant_get(x, "$", "bigint"))
    )


def python_int_of_float(x: Column) -> Column:
    """``int(float(v))`` for a JSON value, NULL where Python raises (F-2b core)."""
    t = J.vtype(x)
    s = J.as_string(x)
    d = (
        F.when(t == "BOOLEAN", F.when(F.try_variant_get(x, "$", "boolean"), 1.0).otherwise(0.0))
        .when(t == "STRING", F.when(s.rlike(_FLOAT_TEXT), F.trim(s).try_cast("double")))
        .when(J.is_numeric(x), F.try_variant_get(x, "$", "double"))
    )
    # nan and inf cannot become an int: NULL (Python: None for nan text, error for inf)
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(9.2e18)), d.try_cast("bigint"))


def salary_a(x: Column) -> Column:
    """F-2a: None -> NULL, else ``int(v)``; 0 stays 0."""
    return python_int(x)


def salary_b(x: Column) -> Column:
    """F-2b: None or numeric 0 -> NULL, else ``int(float(v))``; the text '0' gives 0."""
    zero_number = J.is_numeric(x) & (F.try_variant_get(x, "$", "double") == 0)
    zero_bool = (J.vtype(x) == "BOOLEAN") & ~F.coalesce(F.try_variant_get(x, "$", "boolean"), F.lit(True))
    return F.when(J.is_null_or_absent(x) | zero_number | zero_bool, F.lit(None).cast("bigint")).otherwise(
        python_int_of_float(x))


# ---------------------------------------------------------------- timestamps

def posted_from_epoch(*candidates: Column) -> Column:
    """F-1a: first truthy candidate, ``int()`` of it, as UTC seconds; failures -> NULL."""
    chosen = F.lit(None).cast("variant")
    for c in reversed(candidates):
        chosen = F.when(J.truthy(c), c).otherwise(chosen)
    return seconds_to_ntz(python_int(chosen))


_ISO_DATE = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?)?(Z|[+-]\d{2}:?\d{2})?$"


def iso_to_ntz(s: Column) -> Column:
    """ISO-8601 text -> UTC TIMESTAMP_NTZ; text without a zone is read as UTC.

    Only the forms ``datetime.fromisoformat`` accepts are let through (Spark's
    parser alone also takes a bare year or a time of day).
    """
    t = F.trim(s)
    with_zone = F.when(t.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), t).otherwise(
        F.when(F.length(t) == 10, F.concat(t, F.lit("T00:00:00Z"))).otherwise(F.concat(t, F.lit("Z"))))
    ts = F.try_to_timestamp(with_zone)
    return F.when(t.rlike(_ISO_DATE), micros_to_ntz(F.unix_micros(ts)))


def posted_iso_first(iso: Column, ts: Column) -> Column:
    """F-1b: a truthy ISO text wins (failure -> NULL, no fall-through); else epoch seconds."""
    return F.when(J.truthy(iso), iso_to_ntz(J.as_string(iso))).when(
        J.truthy(ts), seconds_to_ntz(python_int(ts)))


# ---------------------------------------------------------------- fields

def canonical_url_a(slug: Column, url: Column, apply_url: Column, external_id: Column,
                    site: str = "https://remoteok.com/remote-jobs/") -> Column:
    """F-4: slug route first; else url/apply_url with the host case fixed; else by id."""
    raw_url = F.when(J.truthy(url), J.as_string(url)).when(J.truthy(apply_url), J.as_string(apply_url)).otherwise(
        F.lit(""))
    return (
        F.when(J.truthy(slug), F.concat(F.lit(site), J.as_string(slug)))
        .when(raw_url != "", F.replace(raw_url, F.lit("remoteOK.com"), F.lit("remoteok.com")))
        .otherwise(F.concat(F.lit(site), external_id))
    )


def location_compose(job_location: Column, city: Column, state: Column, country: Column,
                     default: str = "Worldwide / Remote") -> Column:
    """F-5: location text, else non-empty city/state/country joined by ', ', else default."""
    parts = [F.when(J.truthy(c), J.as_string(c)) for c in (city, state, country)]
    joined = F.concat_ws(", ", *parts)
    return F.when(J.truthy(job_location), J.as_string(job_location)).when(joined != "", joined).otherwise(
        F.lit(default))


def tag_merge(lists: list[Column], extras: list[Column], cap: int = 8) -> Column:
    """F-6: concat list fields (non-lists skipped), drop falsy, lower; append extra
    values when truthy and absent; order-preserving distinct; first ``cap``.

    "Append when absent, then distinct" equals "append, then distinct", since
    an order-preserving distinct keeps the first occurrence.
    """
    arrays = [F.coalesce(F.when(J.is_array(c), F.try_variant_get(c, "$", "array<variant>")),
                         F.array().cast("array<variant>")) for c in lists]
    base = F.transform(F.filter(F.concat(*arrays), lambda e: J.truthy(e)), lambda e: F.lower(J.as_string(e)))
    more = F.filter(F.array(*[F.when(J.truthy(x), F.lower(J.as_string(x))) for x in extras]),
                    lambda e: e.isNotNull())
    return F.slice(F.array_distinct(F.concat(base, more)), 1, cap)


def remote_b(is_remote: Column, arrangement: Column) -> Column:
    """F-7: truthy ``job_is_remote`` or ``work_arrangement == 'remote'``."""
    return J.truthy(is_remote) | F.coalesce(J.is_string(arrangement) & (J.as_string(arrangement) == "remote"),
                                            F.lit(False))


# ---------------------------------------------------------------- serving text

def relative_time(posted_at: Column, ingested_at: Column, as_of: Column) -> Column:
    """F-8: 'Just now' / 'Nm ago' / 'Nh ago' / '1d ago' / 'Nd ago' / 'Nw ago' / 'Active'."""
    base = F.coalesce(posted_at, ingested_at, as_of)
    ms = F.timestamp_diff("MILLISECOND", base, as_of)
    m = F.floor(ms / F.lit(60000.0)).cast("bigint")
    h = F.floor(ms / F.lit(3600000.0)).cast("bigint")
    d = F.floor(ms / F.lit(86400000.0)).cast("bigint")
    return (
        F.when(m <= 0, F.lit("Just now"))
        .when(m < 60, F.concat(m.cast("string"), F.lit("m ago")))
        .when(h < 24, F.concat(h.cast("string"), F.lit("h ago")))
        .when(d == 1, F.lit("1d ago"))
        .when(d < 7, F.concat(d.cast("string"), F.lit("d ago")))
        .when(d <= 14, F.concat(F.floor(d / 7).cast("bigint").cast("string"), F.lit("w ago")))
        .otherwise(F.lit("Active"))
    )


def _k(n: Column) -> Column:
    # JavaScript Math.round: floor(x + 0.5)
    return F.concat(F.lit("$"), F.floor(n / F.lit(1000.0) + F.lit(0.5)).cast("bigint").cast("string"), F.lit("k"))


def salary_label(lo: Column, hi: Column) -> Column:
    """F-9: '$ak–$bk', 'From $ak', 'Up to $bk'; NULL and 0 count as absent."""
    has_lo = F.coalesce(lo != 0, F.lit(False))
    has_hi = F.coalesce(hi != 0, F.lit(False))
    return (
        F.when(has_lo & has_hi, F.concat(_k(lo), F.lit("–"), _k(hi)))
        .when(has_lo, F.concat(F.lit("From "), _k(lo)))
        .when(has_hi, F.concat(F.lit("Up to "), _k(hi)))
    )


# Whitespace that JavaScript String.prototype.trim removes (ASCII part plus NBSP,
# line/paragraph separators and BOM).
_JS_WS = " \t\n\r\u000b\u000c                 　﻿"


def dedup_key(c: Column) -> Column:
    """F-10: ``lower(trim(x))`` with JavaScript whitespace."""
    return F.lower(F.btrim(c.cast("string"), F.lit(_JS_WS)))


def pair_key(company: Column, title: Column) -> Column:
    return F.concat(dedup_key(company), F.lit(":::"), dedup_key(title))


def format_ts(ts: Column) -> Column:
    """F-14: 'YYYY-MM-DD HH:MM:SS UTC', an em dash for NULL."""
    return F.coalesce(F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")), F.lit("—"))
