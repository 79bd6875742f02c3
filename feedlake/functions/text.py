"""Text rules: block-page phrases, country names, free-text search prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the behaviour being matched; kept verbatim, in order)
# ---------------------------------------------------------------------------
# Phrases of CAPTCHA / firewall challenge pages, matched as lower-case substrings.
BLOCK_PHRASES = [
    "captcha",
    "access denied",
    "403 forbidden",
    "cloudflare",
    "ray id",
    "just a moment",
    "perimeterx",
    "akamai",
    "bot detection",
    "please verify",
    "are you human",
    "unusual traffic",
    "automated requests",
    "enable javascript",
    "ddos protection",
]

# Country names (lower case) -> ISO 3166-1 alpha-2 code.
COUNTRY_CODES = {
    "india": "in",
    "in": "in",
    "united states": "us",
    "usa": "us",
    "us": "us",
    "america": "us",
    "united kingdom": "gb",
    "uk": "gb",
    "great britain": "gb",
    "canada": "ca",
    "germany": "de",
    "deutschland": "de",
    "france": "fr",
    "australia": "au",
    "singapore": "sg",
    "netherlands": "nl",
    "japan": "jp",
    "brazil": "br",
}

# Leading search-intent prefixes; the first that matches is removed (no word boundary).
PROMPT_PREFIXES = ["find", "search for", "search", "looking for", "show me", "get", "list"]

# Trailing filler words; each is tested once, in this order, without stopping.
PROMPT_SUFFIXES = ["jobs", "job", "positions", "position", "openings", "opening", "roles", "role"]

# Words that mark a prompt as remote-only.
REMOTE_MARKERS = ["remote", "wfh", "work from home"]
# Case variants of "remote" removed from the role text.
REMOTE_VARIANTS = ["remote", "Remote", "REMOTE"]
# ---------------------------------------------------------------------------


def pystrip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace of any kind (Unicode blanks, file to unit separators)."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def block_phrase_array() -> Column:
    return F.array(*[F.lit(p) for p in BLOCK_PHRASES])


def looks_like_block_page(text: Column) -> Column:
    """VAL-5 / F-16: lower-cased text contains any block phrase (substring match)."""
    low = F.lower(text)
    return F.exists(block_phrase_array(), lambda p: F.contains(low, p))


def country_map() -> Column:
    kv = []
    for k, v in COUNTRY_CODES.items():
        kv += [F.lit(k), F.lit(v)]
    return F.create_map(*kv)


def country_code(name: Column) -> Column:
    """F-12: country name (any case) -> code, NULL when unknown."""
    return F.try_element_at(country_map(), F.lower(name))


def strip_prefix(text: Column) -> Column:
    """Remove the first matching search-intent prefix (case-insensitive), then strip."""
    low = F.lower(text)
    out = text
    for p in reversed(PROMPT_PREFIXES):
        out = F.when(low.startswith(p), pystrip(F.substring(text, len(p) + 1, 1 << 30))).otherwise(out)
    return out


def strip_suffix(role: Column, suffix: str) -> Column:
    """One suffix step: drop ``suffix`` (case-insensitive) from a non-empty role, then strip."""
    hit = F.coalesce(F.length(role) > 0, F.lit(False)) & F.lower(role).endswith(suffix)
    return F.when(hit, pystrip(F.left(role, F.length(role) - F.lit(len(suffix))))).otherwise(role)


def remove_remote(role: Column) -> Column:
    """Drop the case variants of 'remote' from a non-empty role; empty -> NULL."""
    out = role
    for v in REMOTE_VARIANTS:
        out = F.replace(out, F.lit(v), F.lit(""))
    out = pystrip(out)
    return F.when(role.isNull() | (role == ""), role).otherwise(F.when(out != "", out))


def is_remote_prompt(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for m in REMOTE_MARKERS:
        out = out | F.contains(low, F.lit(m))
    return out
