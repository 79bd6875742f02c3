"""Request-planning queries: search specs and prompts built from ``part`` and ``nation``."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedlake.functions import text as TX
from feedlake.operators import requests as RQ
from feedlake.plans.registry import ORACLE, query
from feedlake.sources.tables import table


def _part_nation(spark, d):
    """Each part with one nation (nation key = part key mod 25): an equi-join."""
    p = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return p.join(n, (p.p_partkey % 25) == n.n_nationkey)


def search_specs(spark, d):
    k = F.col("p_partkey")
    return _part_nation(spark, d).select(
        "p_partkey",
        F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, F.concat(F.lit("  "), "p_name", F.lit("  ")))
        .otherwise(F.col("p_name")).alias("role"),
        (k % 4 != 0).alias("country_given"),
        F.when(k % 4 == 2, F.lit(" DE ")).when(k % 4 == 3, F.col("n_name")).alias("country"),
        F.when(k % 3 == 1, F.concat(F.lit(" "), "n_name")).when(k % 3 == 2, F.lit("")).alias("location"),
        (F.col("p_size") % 2 == 0).alias("remote_only"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("p_size") * 12 - 30).alias("total_jobs"),
        F.lit(1).alias("page"), F.lit(1).alias("num_pages"),
        F.when(k % 2 == 0, F.lit("all")).otherwise(F.lit("week")).alias("date_posted"))


@query("request_plan", """
select p_partkey,
  not (p_partkey % 11 <> 0 and p_size * 12 - 30 < 1) as valid,
  case when p_partkey % 11 <> 0 and p_size * 12 - 30 < 1
       then 'total_jobs must be >= 1, got ' || cast(p_size * 12 - 30 as varchar) end as error,
  case when p_partkey % 7 = 0 then 'Software Engineer' else p_name end as query,
  '1' as num_pages,
  case when p_partkey % 2 = 0 then 'all' else 'week' end as date_posted,
  case p_partkey % 4 when 0 then 'us' when 1 then null when 2 then 'de' else lower(n_name) end as country,
  case when p_partkey % 3 = 1 then n_name end as location,
  case when p_size % 2 = 0 then 'true' end as work_from_home,
  cast(case when p_partkey % 11 = 0 then 10 when p_size * 12 - 30 < 1 then null
            else least(p_size * 12 - 30, 500) end as bigint) as total_jobs,
  coalesce(p_partkey % 11 <> 0 and p_size * 12 - 30 > 500, false) as capped,
  cast(1 as bigint) as page
from part join nation on n_nationkey = p_partkey % 25""")
def request_plan(spark, d):
    """REQ-1/REQ-2: defaults, validation and request parameters per search spec."""
    return RQ.plan_requests(search_specs(spark, d), ["p_partkey"])


_JSON = "case when {0} is not null then ',\"{0}\":\"' || {0} || '\"' else '' end"


@query("request_params", "with plan as (" + ORACLE["request_plan"] + """),
given as (select *, case p_partkey % 5 when 0 then 'c' || cast(p_partkey as varchar) end as cursor from plan where valid)
select p_partkey, '{"query":"' || query || '","num_pages":"' || num_pages || '","date_posted":"' || date_posted || '"' || """
       + " || ".join(_JSON.format(c) for c in ("country", "location", "work_from_home", "cursor")) + " || '}' as params from given")
def request_params(spark, d):
    """REQ-2: the parameter set of each valid search, with a cursor in some and an empty one in others."""
    k = F.col("p_partkey")
    cursor = F.when(k % 5 == 0, F.concat(F.lit("c"), k.cast("string"))).when(k % 5 == 1, F.lit(""))
    return RQ.request_params(RQ.plan_requests(search_specs(spark, d), ["p_partkey"]), ["p_partkey"], cursor)


_PREFIXES = ["Find ", "Search for ", "Show me remote ", "list ", "", "Get "]
_SUFFIXES = [" jobs", " positions", " roles", ""]


def prompts(spark, d):
    k = F.col("p_partkey")
    pre = F.element_at(F.array(*[F.lit(x) for x in _PREFIXES]), (k % len(_PREFIXES) + 1).cast("int"))
    suf = F.element_at(F.array(*[F.lit(x) for x in _SUFFIXES]), (k % len(_SUFFIXES) + 1).cast("int"))
    place = (F.when(k % 8 == 0, F.lit("India")).when(k % 8 == 1, F.concat("n_name", F.lit(", USA")))
             .when(k % 8 == 2, F.col("n_name")).when(k % 8 == 3, F.lit("Berlin, Germany"))
             .when(k % 8 == 4, F.lit("")).when(k % 8 == 5, F.lit("UK"))
             .when(k % 8 == 6, F.concat("n_name", F.lit(", Narnia"))).otherwise(F.lit("Remote")))
    text = F.concat(pre, "p_name", suf, F.when(place != "", F.concat(F.lit(" in "), place)).otherwise(F.lit("")))
    return _part_nation(spark, d).select("p_partkey", F.when(k % 50 == 49, F.lit("   ")).otherwise(text)
                                         .alias("prompt"))


def _sql_list(xs):
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


def _prompt_sql() -> str:
    country_case = "case lower({x}) " + " ".join(
        f"when '{k}' then '{v}'" for k, v in TX.COUNTRY_CODES.items()) + " end"
    prefix_case = "case " + " ".join(
        f"when starts_with(lower(text), '{p}') then trim(substr(text, {len(p) + 1}))" for p in TX.PROMPT_PREFIXES
    ) + " else text end"
    steps = ["r0 as (select *, case when has_in then nullif(role_cand, '') else cleaned end as role from parsed)"]
    prev = "r0"
    for i, s in enumerate(TX.PROMPT_SUFFIXES, 1):
        steps.append(
            f"r{i} as (select * replace (case when role is not null and role <> '' and ends_with(lower(role), '{s}') "
            f"then trim(left(role, length(role) - {len(s)})) else role end as role) from {prev})")
        prev = f"r{i}"
    no_remote = "trim(replace(replace(replace(role, 'remote', ''), 'Remote', ''), 'REMOTE', ''))"
    return f"""
with pr as (
  select p_partkey,
    case when p_partkey % 50 = 49 then '   ' else
      {_sql_list(_PREFIXES)}[p_partkey % {len(_PREFIXES)} + 1] || p_name || {_sql_list(_SUFFIXES)}[p_partkey % {len(_SUFFIXES)} + 1]
      || case p_partkey % 8 when 0 then ' in India' when 1 then ' in ' || n_name || ', USA'
           when 2 then ' in ' || n_name when 3 then ' in Berlin, Germany' when 4 then ''
           when 5 then ' in UK' when 6 then ' in ' || n_name || ', Narnia' else ' in Remote' end
    end as prompt
  from part join nation on n_nationkey = p_partkey % 25),
t as (select p_partkey, trim(prompt) as text, trim(prompt) = '' as blank from pr),
c as (select *, {prefix_case} as cleaned,
        contains(lower(text), 'remote') or contains(lower(text), 'wfh')
          or contains(lower(text), 'work from home') as remote_only from t),
parsed as (
  select *, contains(cleaned, ' in ') as has_in,
    trim(split_part(cleaned, ' in ', 1)) as role_cand,
    trim(substr(cleaned, strpos(cleaned, ' in ') + 4)) as place
  from c),
{", ".join(steps)},
fin as (
  select *, {country_case.format(x='place')} as place_code,
    trim(split_part(place, ',', 1)) as loc_head,
    trim(substr(place, strpos(place, ',') + 1)) as loc_tail
  from {prev})
select p_partkey,
  case when blank then null when role is null or role = '' then role else nullif({no_remote}, '') end as role,
  case when blank or not has_in then null when place_code is not null then place_code
       when contains(place, ',') then {country_case.format(x='loc_tail')} end as country,
  case when blank or not has_in or place_code is not null then null
       when contains(place, ',') then loc_head else place end as location,
  case when blank then false else remote_only end as remote_only
from fin"""


@query("prompt_parse", _prompt_sql())
def prompt_parse(spark, d):
    """REQ-3/F-12: role, country, location and remote flag from free-text prompts."""
    return RQ.parse_prompts(prompts(spark, d), "prompt", ["p_partkey"])


_U = "(('0x' || substr(md5('{}:' || conv_id || ':' || turn), 1, 12))::bigint + 0.5) / 281474976710656.0"


@query("request_offsets", f"""
with d as (select conv_id, turn as request_no,
    exp(ln(3.0) + 0.4 * sqrt(-2 * ln({_U.format('a')})) * cos(2 * pi() * {_U.format('b')})) as delay_s from conversations)
select conv_id, request_no, round(delay_s, 6) as delay_s,
  round(sum(delay_s) over (partition by conv_id order by request_no), 6) as offset_s from d""")
def request_offsets(spark, d):
    """F-13: log-normal pauses (mu 3 s, sigma 0.4) drawn from (fetch, request), and offsets per request."""
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("request_no"))
    out = RQ.request_offsets(c, "conv_id", "request_no", 3.0, 0.4)
    return out.select("conv_id", "request_no", F.round("delay_s", 6).alias("delay_s"), F.round("offset_s", 6).alias("offset_s"))
