"""Field-rule queries: URL, location, tags, HTML extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions import json as J
from feedlake.functions import rules as R
from feedlake.operators import extract as X
from feedlake.operators.extract import extract_listing
from feedlake.plans.registry import query
from feedlake.sources.tables import raw_feed_b, table


def _page_records(spark, d):
    p = table(spark, d, "pages").select("page_id", "url")
    i = F.col("page_id")
    raw = J.json_record([
        ("id", i.cast("string")),
        ("slug", F.when(i % 3 == 0, F.concat(F.lit("p"), i.cast("string")))),
        ("url", F.when(i % 3 == 1, F.concat(F.lit("https://remoteOK.com/"), i.cast("string")))
         .when(i % 6 == 5, F.lit(""))),
        ("apply_url", F.when(i % 6 == 2, F.col("url"))),
    ])
    return p.select("page_id", raw.alias("raw"))


@query("canonical_url", """
select page_id,
  case when page_id % 3 = 0 then 'https://remoteok.com/remote-jobs/p' || cast(page_id as varchar)
       when page_id % 3 = 1 then 'https://remoteok.com/' || cast(page_id as varchar)
       when page_id % 6 = 2 then replace(url, 'remoteOK.com', 'remoteok.com')
       else 'https://remoteok.com/remote-jobs/' || cast(page_id as varchar) end as canonical_url
from pages""")
def canonical_url(spark, d):
    """F-4: slug route, else url/apply_url with the host case fixed, else by id."""
    df, g = J.stage_fields(_page_records(spark, d), "raw", ["id", "slug", "url", "apply_url"], ["page_id"])
    return df.select("page_id", R.canonical_url_a(g("slug"), g("url"), g("apply_url"), J.as_string(g("id")))
                     .alias("canonical_url"))


@query("location_compose", """
select cast(o_orderkey as varchar) as external_id,
  case o_orderkey % 4 when 0 then n_name || ', ' || r_name when 1 then n_name || ', ' || r_name
    when 2 then 'Worldwide / Remote' else r_name end as location
from orders join customer on c_custkey = o_custkey
  join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey""")
def location_compose(spark, d):
    """F-5: location text, else city/state/country joined, else the default."""
    df, g = J.stage_fields(raw_feed_b(spark, d), "raw",
                           ["job_location", "job_city", "job_state", "job_country"], ["o_orderkey"])
    return df.select(F.col("o_orderkey").cast("string").alias("external_id"),
                     R.location_compose(g("job_location"), g("job_city"), g("job_state"), g("job_country"))
                     .alias("location"))


def _part_records(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    raw = J.json_record([
        ("required_technologies", F.split("p_type", " ")),
        ("preferred_technologies", F.array("p_brand", F.lit(""))),
        ("job_required_skills", F.when(F.col("p_partkey") % 5 == 0, F.col("p_name"))),
        ("job_required_skills", F.when(F.col("p_partkey") % 5 != 0, F.split("p_name", " "))),
        ("job_function", F.col("p_type")),
        ("job_employment_type", F.when(F.col("p_size") % 2 == 0, F.lit("FULLTIME"))),
    ])
    return p.select("p_partkey", raw.alias("raw"))


@query("tag_merge", """
with t as (
  select p_partkey, p_size,
    list_concat([lower(p_type), lower(p_brand)],
                case when p_partkey % 5 = 0 then []::varchar[]
                     else list_transform(string_split(p_name, ' '), lambda w: lower(w)) end) as l
  from part),
d as (select p_partkey, p_size, list_filter(l, lambda x, i: list_position(l, x) = i) as l from t),
e as (select p_partkey,
        case when p_size % 2 = 0 and not list_contains(l, 'fulltime') then list_append(l, 'fulltime') else l end as l
      from d)
select p_partkey, array_to_string(l[1:8], '|') as tags from e""")
def tag_merge(spark, d):
    """F-6: merged, lower-cased, order-preserving distinct tags (first 8)."""
    df, g = J.stage_fields(_part_records(spark, d), "raw",
                           ["required_technologies", "preferred_technologies", "job_required_skills",
                            "job_function", "job_employment_type"], ["p_partkey"])
    tags = R.tag_merge([g("required_technologies"), g("preferred_technologies"), g("job_required_skills")],
                       [g("job_function"), g("job_employment_type")])
    return df.select("p_partkey", F.array_join(tags, "|").alias("tags"))


_PLANT_LD = ("case when page_id % 8 = 0 then '<script type=\"application/ld+json\">{\"@type\":\"JobPosting\","
             "\"title\":\"Planted ' || cast(page_id as varchar) || '\"}</script>' || html else html end")


@query("html_listing_extract", f"""
with p as (select page_id, {_PLANT_LD} as h from pages),
x as (select page_id,
  json_extract_string(nullif(regexp_extract(h, '<script[^>]*type="application/ld\\+json"[^>]*>([\\s\\S]*?)</script>', 1), ''), '$.title') as ld,
  nullif(trim(regexp_extract(h, '<title[^>]*>([\\s\\S]*?)</title>', 1)), '') as tt,
  nullif(trim(regexp_replace(regexp_extract(h, '<h1[^>]*>([\\s\\S]*?)</h1>', 1), '<[^>]*>', '', 'g')), '') as h1
  from p)
select page_id, coalesce(ld, tt, h1) as title,
  case when ld is not null then 'json-ld' when tt is not null then 'title' when h1 is not null then 'h1'
       else 'none' end as method
from x""")
def html_listing_extract(spark, d):
    """NRM-H: title from JSON-LD (planted in some pages), else <title>, else <h1>."""
    p = table(spark, d, "pages").select("page_id", "html").withColumn("html", F.expr(
        _PLANT_LD.replace("cast(page_id as varchar)", "cast(page_id as string)")))
    return extract_listing(p, "html", ["page_id"])


# Planted in some pages; chr(39) is the single quote and chr(10) the line feed in both dialects.
_PLANT_FIELDS = """html || case when page_id % 3 = 0 then '<div class="job" data-company="co ' || cast(page_id as varchar)
  || '" DATA-Pay=' || chr(39) || cast(page_id * 10 as varchar) || chr(39) || '><dl><dt>Location :</dt>' || chr(10) || '<dd class="x">City  '
  || cast(page_id % 7 as varchar) || '</dd><dt> </dt><dd>no label</dd><dt>Type</dt><dd><i>Full</i> time</dd></dl>' else '' end
  || case when page_id % 4 = 1 then '<table><thead><tr><th>Pay</th><td>' || cast(page_id as varchar)
  || '</td></tr></thead></table><strong>Visa:</strong> yes <br>' else '' end"""


def _all(text: str, pattern: str, group: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_extract_all({text}, '{quoted}', {group})"


def _plain_sql(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace({text}, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"


@query("html_fields_extract", f"""
with p as (select page_id, {_PLANT_FIELDS} as h from pages),
tags as (select page_id, unnest({_all('h', X.TAG, 0)}) as t, generate_subscripts({_all('h', X.TAG, 0)}, 1) as i from p),
found as (select page_id, i, unnest({_all('t', X.DATA, 1)}) as n, unnest({_all('t', X.DATA, 2)}) as v,
            generate_subscripts({_all('t', X.DATA, 1)}, 1) as j from tags),
data as (select page_id, string_agg(lower(n) || '=' || v[2:-2], '|' order by i, j) as data_text from found group by page_id),
pairs as (
  select page_id, 1 as k, unnest({_all('h', X.PAIR, 1)}) as n, unnest({_all('h', X.PAIR, 2)}) as v, generate_subscripts({_all('h', X.PAIR, 1)}, 1) as j from p
  union all
  select page_id, 2, unnest({_all('h', X.BOLD, 1)}), unnest({_all('h', X.BOLD, 2)}), generate_subscripts({_all('h', X.BOLD, 1)}, 1) from p),
plain as (select page_id, k, j, lower(regexp_replace({_plain_sql('n')}, '\\s*:$', '')) as n, {_plain_sql('v')} as v from pairs),
labels as (select page_id, string_agg(n || '=' || v, '|' order by k, j) as label_text from plain where length(n) > 0 group by page_id)
select page_id, coalesce(data_text, '') as data_text, coalesce(label_text, '') as label_text
from p left join data using (page_id) left join labels using (page_id)""")
def html_fields_extract(spark, d):
    """NRM-H: data-* attributes and labelled values of pages, planted in some."""
    p = table(spark, d, "pages").select("page_id", F.expr(_PLANT_FIELDS.replace("as varchar", "as string")).alias("html"))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit("="), x["value"])), "|")
    return X.listing_fields(p, "html", ["page_id"]).select("page_id", text("data_fields").alias("data_text"), text("labelled_fields").alias("label_text"))
