"""Listing extraction from raw HTML (NRM-H): structured data first, then markup.

JSON-LD blocks (``<script type="application/ld+json">``; lists and ``@graph`` are
taken apart) are read as JSON and ``title``/``name`` of the first JobPosting, or
else of the first item, used; pages without one fall back to ``<title>``,
then to the first ``<h1>``. Beside the title, ``listing_fields`` reads ``data-*``
attributes of tags and labelled values (``<dt>``/``<dd>`` and ``<th>``/``<td>``
pairs, a bold label with a colon). All regular-expression work stays in the JVM.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LD = r"""(?i)<script[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>([\s\S]*?)</script>"""
_TITLE = r"<title[^>]*>([\s\S]*?)</title>"
_H1 = r"<h1[^>]*>([\s\S]*?)</h1>"


def extract_listing(df: DataFrame, html_col: str, keep: list[str]) -> DataFrame:
    whole = lambda v: F.try_variant_get(v, "$", "array<variant>")
    graph = lambda v: F.try_variant_get(v, "$[\"@graph\"]", "array<variant>")
    blocks = F.transform(F.regexp_extract_all(F.col(html_col), F.lit(_LD), F.lit(1)), F.try_parse_json)
    items = F.flatten(F.transform(F.filter(blocks, lambda v: v.isNotNull()), lambda v: F.coalesce(whole(v), graph(v), F.array(v))))
    kind = lambda v: F.lower(F.coalesce(F.try_variant_get(v, "$[\"@type\"]", "string"), F.lit("")))
    staged = df.select(*keep, F.col(html_col).alias("_h"), items.alias("_items"))
    posting = F.filter("_items", lambda v: kind(v).contains("jobposting"))
    staged = staged.withColumn("_ld", F.coalesce(F.get(posting, F.lit(0)), F.get("_items", F.lit(0))))
    ld_title = F.coalesce(F.try_variant_get("_ld", "$.title", "string"), F.try_variant_get("_ld", "$.name", "string"))
    title_tag = F.nullif(F.trim(F.regexp_extract("_h", _TITLE, 1)), F.lit(""))
    h1 = F.nullif(F.trim(F.regexp_replace(F.regexp_extract("_h", _H1, 1), "<[^>]*>", "")), F.lit(""))
    return staged.select(
        *keep,
        F.coalesce(ld_title, title_tag, h1).alias("title"),
        F.when(ld_title.isNotNull(), F.lit("json-ld")).when(title_tag.isNotNull(), F.lit("title"))
        .when(h1.isNotNull(), F.lit("h1")).otherwise(F.lit("none")).alias("method"))


#: An opening tag, an attribute in it, and both spellings of a labelled value.
TAG = r"<[A-Za-z][^<>]*>"
DATA = r"""(?i)\sdata-([a-z0-9_-]+)\s*=\s*("[^"]*"|'[^']*')"""
PAIR = r"(?i)<(?:dt|th)(?:\s[^>]*)?>([\s\S]*?)</(?:dt|th)>\s*<(?:dd|td)(?:\s[^>]*)?>([\s\S]*?)</(?:dd|td)>"
BOLD = r"(?i)<(?:b|strong)(?:\s[^>]*)?>([^<>:]+):\s*</(?:b|strong)>([^<>]+)"


def _plain(text: Column) -> Column:
    """Text without tags, blanks drawn together."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"[ \t\r\n]+", " "))


def _pairs(text: Column, pattern: str, name: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    """(name, value) of all matches, by the pattern's two groups; those without a name go."""
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("v"))
    named = F.transform(both, lambda p: F.struct(name(p["n"]).alias("name"), value(p["v"]).alias("value")))
    return F.filter(named, lambda p: F.length(p["name"]) > 0)


def listing_fields(df: DataFrame, html_col: str, keep: list[str]) -> DataFrame:
    """NRM-H: data_fields and labelled_fields of a page, arrays of (name, value) in the order of the page, names in lower case.

    Attributes count inside tags only; a label's closing colon is no part of its name.
    """
    tags = F.regexp_extract_all(F.col(html_col), F.lit(TAG), F.lit(0))
    data = F.flatten(F.transform(tags, lambda t: _pairs(t, DATA, F.lower, lambda v: F.substring(v, F.lit(2), F.length(v) - 2))))
    label = lambda n: F.lower(F.regexp_replace(_plain(n), r"\s*:$", ""))
    labelled = F.concat(_pairs(F.col(html_col), PAIR, label, _plain), _pairs(F.col(html_col), BOLD, label, _plain))
    return df.select(*keep, data.alias("data_fields"), labelled.alias("labelled_fields"))
