"""Per-feed normalisers: raw JSON records -> the canonical listing schema.

Each normaliser is one ``select`` over a VARIANT parsed once per record, so a
feed of any size is normalised in a single narrow stage (no shuffle). Records
without an id are dropped (FLT-1); other columns of the input (batch id,
position, ...) can be carried through with ``keep``.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from feedlake.functions import json as J
from feedlake.functions import rules as R
from feedlake.schema import CANONICAL, CANONICAL_FIELDS



def _null_bool() -> Column:
    return F.lit(None).cast("boolean")


def _null_long() -> Column:
    return F.lit(None).cast("bigint")


def _fields(df: DataFrame, raw_col: str, keys: list[str], keep: list[str]):
    return J.stage_fields(df, raw_col, keys, keep)


def has_id() -> Column:
    return F.coalesce(F.length("external_id") > 0, F.lit(False))


def _finish(df: DataFrame, cols: dict[str, Column], keep: list[str], drop: bool) -> DataFrame:
    """Project the canonical columns and drop records without an id (FLT-1), or keep them (``drop`` unset).

    The drop is a generator of zero or one row per record rather than a
    filter: the optimizer would push a filter on ``external_id`` below the
    staged projections and evaluate the JSON parse a second time.
    """
    out = df.select(*keep, *[cols[n].cast(CANONICAL[n].dataType).alias(n) for n in CANONICAL_FIELDS])
    if not drop:
        return out
    row = F.struct(*[F.col(c) for c in keep + CANONICAL_FIELDS])
    return out.select(F.inline(F.filter(F.array(row), lambda _: has_id())))


def normalise_flat(df: DataFrame, source: str = "feed_a", raw_col: str = "raw",
                   keep: list[str] | None = None, drop: bool = True) -> DataFrame:
    """NRM-A: flat-array feed (id, position, company, url, slug, epoch/date, salaries, tags)."""
    keep = keep or []
    df, g = _fields(df, raw_col, ["id", "position", "company", "location", "slug", "url", "apply_url", "tags",
                                  "salary_min", "salary_max", "epoch", "date"], keep)
    # Documented deviation: a JSON null id drops the record, as in the other feeds.
    ext = F.when(~J.is_null_or_absent(g("id")), J.as_string(g("id")))
    cols = {
        "source": F.lit(source),
        "external_id": ext,
        "title": J.text_or(g("position"), ""),
        "company": J.text_or(g("company"), ""),
        "location": J.text_or(g("location"), "Worldwide / Remote"),
        "url": R.canonical_url_a(g("slug"), g("url"), g("apply_url"), ext),
        "tags": F.coalesce(F.when(J.truthy(g("tags")), J.string_list(g("tags"))), F.array().cast("array<string>")),
        "salary_min": R.salary_a(g("salary_min")),
        "salary_max": R.salary_a(g("salary_max")),
        "visa_sponsorship": _null_bool(),
        "four_day_week": _null_bool(),
        "remote": F.lit(True),
        "posted_at": R.posted_from_epoch(g("epoch"), g("date")),
        "raw": F.col("_raw"),
    }
    return _finish(df, cols, keep, drop)


def normalise_cursor(df: DataFrame, source: str = "feed_b", raw_col: str = "raw",
                     keep: list[str] | None = None, drop: bool = True) -> DataFrame:
    """NRM-B: cursor-paged search feed (job_* keys)."""
    keep = keep or []
    df, g = _fields(df, raw_col, ["job_id", "job_title", "employer_name", "job_location", "job_city", "job_state",
                                  "job_country", "job_apply_link", "required_technologies",
                                  "preferred_technologies", "job_required_skills", "job_function",
                                  "job_employment_type", "job_min_salary", "job_max_salary", "job_is_remote",
                                  "work_arrangement", "job_posted_at_datetime_utc", "job_posted_at_timestamp"], keep)
    cols = {
        "source": F.lit(source),
        "external_id": J.text_or(g("job_id"), ""),
        "title": J.text_or(g("job_title"), ""),
        "company": J.text_or(g("employer_name"), ""),
        "location": R.location_compose(g("job_location"), g("job_city"), g("job_state"), g("job_country")),
        "url": J.text_or(g("job_apply_link"), ""),
        "tags": R.tag_merge([g("required_technologies"), g("preferred_technologies"), g("job_required_skills")],
                            [g("job_function"), g("job_employment_type")]),
        "salary_min": R.salary_b(g("job_min_salary")),
        "salary_max": R.salary_b(g("job_max_salary")),
        "visa_sponsorship": _null_bool(),
        "four_day_week": _null_bool(),
        "remote": R.remote_b(g("job_is_remote"), g("work_arrangement")),
        "posted_at": R.posted_iso_first(g("job_posted_at_datetime_utc"), g("job_posted_at_timestamp")),
        "raw": F.col("_raw"),
    }
    return _finish(df, cols, keep, drop)


def normalise_paged(df: DataFrame, source: str = "feed_c", raw_col: str = "raw",
                    keep: list[str] | None = None, drop: bool = True) -> DataFrame:
    """NRM-C: page-numbered board feed (slug, title, company_name, booleans, created_at)."""
    keep = keep or []
    df, g = _fields(df, raw_col, ["slug", "title", "company_name", "location", "url", "tags", "visa_sponsorship",
                                  "four_day_week", "remote", "created_at"], keep)
    cols = {
        "source": F.lit(source),
        "external_id": J.text_or(g("slug"), ""),
        "title": J.text_or(g("title"), ""),
        "company": J.text_or(g("company_name"), ""),
        "location": J.text_or(g("location"), ""),
        "url": J.text_or(g("url"), ""),
        "tags": F.coalesce(F.when(J.truthy(g("tags")), J.string_list(g("tags"))), F.array().cast("array<string>")),
        "salary_min": _null_long(),
        "salary_max": _null_long(),
        "visa_sponsorship": J.truthy(g("visa_sponsorship")),
        "four_day_week": J.truthy(g("four_day_week")),
        "remote": J.truthy(g("remote")),
        "posted_at": R.posted_from_epoch(g("created_at")),
        "raw": F.col("_raw"),
    }
    return _finish(df, cols, keep, drop)


def parse_counts(raw: DataFrame, normalised: DataFrame, by: list[str]) -> DataFrame:
    """AGG-5: parsed and skipped record counts per group (e.g. per source)."""
    n_in = raw.groupBy(*by).agg(F.count(F.lit(1)).alias("received"))
    n_ok = normalised.groupBy(*by).agg(F.count(F.lit(1)).alias("parsed"))
    return (n_in.join(n_ok, by, "left")
            .select(*by, F.col("received").cast("bigint").alias("received"),
                    F.coalesce("parsed", F.lit(0)).cast("bigint").alias("parsed"),
                    (F.col("received") - F.coalesce("parsed", F.lit(0))).cast("bigint").alias("skipped")))


def counted(raw: DataFrame, spec: FeedSpec, name: str | Observation, raw_col: str = "raw", keep: list[str] | None = None) -> DataFrame:
    """AGG-5 in the pass that writes: normalised records, observed under ``name`` as received, parsed and skipped.

    Each received record is one row until it has been counted; the counters add no scan and no shuffle.
    """
    keep = keep or []
    whole = spec.normaliser(raw, source=spec.source_id, raw_col=raw_col, keep=keep, drop=False)
    ok = F.count_if(has_id())
    return whole.observe(name, F.count(F.lit(1)).alias("received"), ok.alias("parsed"), F.count_if(~has_id()).alias("skipped")).where(has_id())


@dataclass(frozen=True)
class FeedSpec:
    """A registered feed: identity, batch rules and its normaliser."""

    source_id: str
    required_keys: tuple[str, ...]
    normaliser: Callable[..., DataFrame]
    min_items: int = 1
    priority: int = 100
    enabled: bool = True
    label: str = ""
    extra: dict = field(default_factory=dict)
    stable_keys: tuple[str, ...] = ()

    def normalise(self, df: DataFrame, raw_col: str = "raw", keep: list[str] | None = None) -> DataFrame:
        return self.normaliser(df, source=self.source_id, raw_col=raw_col, keep=keep)


# ---------------------------------------------------------------------------
# Required keys of the three feed shapes.
# ---------------------------------------------------------------------------
FLAT_REQUIRED = ("id", "position", "company", "url")
CURSOR_REQUIRED = ("job_id", "job_title", "job_apply_link")
PAGED_REQUIRED = ("slug", "title", "company_name", "url")
# ---------------------------------------------------------------------------

REGISTRY: dict[str, FeedSpec] = {}


def register(spec: FeedSpec) -> FeedSpec:
    """Add a feed; normalisers must yield exactly the canonical columns (NRM-E)."""
    REGISTRY[spec.source_id] = spec
    return spec


register(FeedSpec("feed_a", FLAT_REQUIRED, normalise_flat, priority=1, enabled=True, label="Feed A",
                  extra={"scan_key": "id"}))
register(FeedSpec("feed_b", CURSOR_REQUIRED, normalise_cursor, priority=2, enabled=True, label="Feed B",
                  extra={"envelope": True}))
register(FeedSpec("feed_c", PAGED_REQUIRED, normalise_paged, priority=3, enabled=False, label="Feed C",
                  extra={"envelope": True}))


def unify(*frames: DataFrame, fields: list[str] = CANONICAL_FIELDS) -> DataFrame:
    """SET-1 / NRM-E: bag union of normalised feeds; each must have the canonical ``fields``, by name and by type."""
    for df in frames:
        held = {f.name: f.dataType for f in df.schema}
        wrong = [c for c in fields if c not in held or held[c] != CANONICAL[c].dataType]
        if wrong:
            raise ValueError(f"feed output lacks canonical columns or has them in another type: {wrong}")
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out
