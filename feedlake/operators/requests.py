"""Request planning over a table of searches (REQ-1..3) and request pacing (F-13).

A search spec is one row; defaulting, validation and request parameters are
column expressions, so a table of any number of searches is planned in one
narrow stage. Invalid specs are kept with an error text (quarantine them with
a filter), never dropped silently.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedlake.functions import text as TX

# ---------------------------------------------------------------------------
# Search defaults and limits.
# ---------------------------------------------------------------------------
DEFAULT_ROLE = "Software Engineer"
DEFAULT_COUNTRY = "us"
DEFAULT_LOCATION = None
DEFAULT_TOTAL_JOBS = 10
MAX_TOTAL_JOBS = 500
# ---------------------------------------------------------------------------


def _nonempty(c: Column) -> Column:
    return F.coalesce(F.length(c) > 0, F.lit(False))


def plan_requests(specs: DataFrame, keep: list[str]) -> DataFrame:
    """REQ-1/REQ-2: defaulted search parameters and the request parameter set.

    ``specs`` columns: role, country_given (bool), country, location,
    remote_only, total_jobs, page, num_pages, date_posted. ``country_given``
    false means "not passed" (default country); true with NULL means "no
    country".
    """
    role = F.when(_nonempty(F.col("role")), TX.pystrip(F.col("role"))).otherwise(F.lit(DEFAULT_ROLE))
    country = F.when(~F.col("country_given"), F.lit(DEFAULT_COUNTRY)).when(
        F.col("country").isNull(), F.lit(None).cast("string")).otherwise(F.lower(TX.pystrip(F.col("country"))))
    location = F.when(_nonempty(F.col("location")), TX.pystrip(F.col("location"))).otherwise(
        F.lit(DEFAULT_LOCATION).cast("string"))
    tj = F.col("total_jobs")
    error = F.when(tj.isNotNull() & (tj < 1), F.concat(F.lit("total_jobs must be >= 1, got "), tj.cast("string")))
    total = F.when(tj.isNull(), F.lit(DEFAULT_TOTAL_JOBS)).otherwise(F.least(tj, F.lit(MAX_TOTAL_JOBS)))
    return specs.select(
        *keep,
        error.isNull().alias("valid"), error.alias("error"),
        role.alias("query"), F.lit("1").alias("num_pages"), F.col("date_posted"),
        F.when(_nonempty(country), country).alias("country"),
        F.when(_nonempty(location), location).alias("location"),
        F.when(F.col("remote_only"), F.lit("true")).alias("work_from_home"),
        F.when(error.isNull(), total).cast("bigint").alias("total_jobs"),
        F.coalesce(error.isNull() & (tj > MAX_TOTAL_JOBS), F.lit(False)).alias("capped"),
        F.greatest(F.lit(1), F.coalesce(F.col("page"), F.lit(1))).cast("bigint").alias("page"),
    )


def request_params(plan: DataFrame, keep: list[str], cursor: Column | None = None) -> DataFrame:
    """REQ-2: the parameters sent for each valid plan as JSON text; unset ones, an empty cursor too, are left out."""
    names = ["query", "num_pages", "date_posted", "country", "location", "work_from_home"]
    given = F.lit(None).cast("string") if cursor is None else F.when(_nonempty(cursor), cursor)
    return plan.where("valid").select(*keep, F.to_json(F.struct(*names, given.alias("cursor"))).alias("params"))


def parse_prompts(df: DataFrame, prompt_col: str, keep: list[str]) -> DataFrame:
    """REQ-3: free-text prompts -> role, country, location, remote_only.

    Rules in order: blank -> all NULL; remote flag from the lower-cased text;
    one leading prefix removed; split at the first `` in `` into role and
    place; place -> country code, or ``location, country``, or location; each
    trailing filler word removed once in list order; 'remote' removed from
    the role. Each step is its own projection so every intermediate value is
    computed once per row. A place marker only in another letter case
    (`` IN ``) is read as no place.
    """
    s = df.select(*keep, TX.pystrip(F.col(prompt_col)).alias("_t"))
    s = s.select(*keep, "_t", (F.coalesce(F.col("_t"), F.lit("")) == "").alias("_blank"),
                 TX.is_remote_prompt(F.col("_t")).alias("_remote"), TX.strip_prefix(F.col("_t")).alias("_c"))
    s = s.select(*keep, "_blank", "_remote", "_c", F.contains("_c", F.lit(" in ")).alias("_has_in"))
    s = s.select(*keep, "_blank", "_remote", "_c", "_has_in",
                 TX.pystrip(F.substring_index("_c", " in ", 1)).alias("_role_cand"),
                 TX.pystrip(F.regexp_extract("_c", r"^[\s\S]*? in ([\s\S]*)$", 1)).alias("_place"))
    s = s.select(*keep, "_blank", "_remote", "_c", "_has_in", "_role_cand", "_place",
                 TX.country_code(F.col("_place")).alias("_code"),
                 TX.pystrip(F.substring_index("_place", ",", 1)).alias("_head"),
                 TX.pystrip(F.regexp_extract("_place", r"^[^,]*,([\s\S]*)$", 1)).alias("_tail"))
    has_comma = F.contains("_place", F.lit(","))
    s = s.select(
        *keep, "_blank", "_remote",
        F.when(F.col("_has_in"), F.when(F.col("_role_cand") != "", F.col("_role_cand"))).otherwise(F.col("_c"))
        .alias("_role"),
        F.when(F.col("_has_in"), F.when(F.col("_code").isNotNull(), F.col("_code"))
               .when(has_comma, TX.country_code(F.col("_tail")))).alias("_country"),
        F.when(F.col("_has_in") & F.col("_code").isNull(), F.when(has_comma, F.col("_head")).otherwise(F.col("_place")))
        .alias("_location"))
    for suffix in TX.PROMPT_SUFFIXES:
        s = s.withColumn("_role", TX.strip_suffix(F.col("_role"), suffix))
    null_s = F.lit(None).cast("string")
    return s.select(*keep,
                    F.when(F.col("_blank"), null_s).otherwise(TX.remove_remote(F.col("_role"))).alias("role"),
                    F.when(F.col("_blank"), null_s).otherwise(F.col("_country")).alias("country"),
                    F.when(F.col("_blank"), null_s).otherwise(F.col("_location")).alias("location"),
                    F.when(F.col("_blank"), F.lit(False)).otherwise(F.col("_remote")).alias("remote_only"))


def uniform(*parts: Column | str) -> Column:
    """A number in (0, 1) drawn from a hash of the parts' texts, alike wherever it is computed."""
    text = F.concat_ws(":", *parts)
    return (F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def lognormal_delays(mu: float, sigma: float, *parts: Column | str) -> Column:
    """F-13: delay ``exp(ln(mu) + sigma * z)``, z a standard normal number drawn from a hash of
    ``parts`` (Box and Muller); mu must be > 0."""
    if mu <= 0:
        raise ValueError(f"mu must be > 0, got {mu}")
    z = F.sqrt(-2 * F.log(uniform(F.lit("a"), *parts))) * F.cos(2 * math.pi * uniform(F.lit("b"), *parts))
    return F.exp(F.lit(math.log(mu)) + F.lit(sigma) * z)


def request_offsets(requests: DataFrame, fetch: str, seq: str, mu: float, sigma: float) -> DataFrame:
    """F-13 planning: a log-normal pause before each request and its offset from
    the fetch start (running sum over the fetch's requests)."""
    d = requests.withColumn("delay_s", lognormal_delays(mu, sigma, fetch, seq))
    w = Window.partitionBy(fetch).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.withColumn("offset_s", F.sum("delay_s").over(w))
