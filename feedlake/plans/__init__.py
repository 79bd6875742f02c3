"""Registered queries over the driver tables (see ``registry``)."""

from feedlake.plans import cooldown, dedup, feeds, fetch, fields, ingest, listings, quality, requests  # noqa: F401
from feedlake.plans.registry import ORACLE, QUERIES  # noqa: F401
