"""Secret scan with multipart credential linking.

Strong patterns (an assigned secret, an access key, a long hex run) are reported
always. Weak ones (user names and short access keys, short or unquoted secrets,
endpoints) are reported only if a complementary part lies within SCOPE code
points of them in the same text: an identifier needs a secret or an endpoint with
one, a secret needs an identifier or an endpoint, an endpoint an identifier or a
secret. The parts are intervals, and what lies between them counts: nothing if they
overlap. They meet by an equi-join on text and stretch of SCOPE code points (each
part in all stretches that it covers, a weak one also in the two beside them), then
by distance, so a text of many parts is spread and no stretch holds more parts than
its length allows.

Positions are code points: a text is split at a pattern's matches, and the
lengths of gaps and matches are summed up in order.

Defined cases: null counts as empty and has no spans; spans of different kinds
may overlap; repeated rows are scanned each on its own; an empty table gives no
rows; further columns are not read. ``docs`` that is not a plain table is written first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedlake.llm.common import scanned, stash, text_or_empty

#: Code points between the end of a part and the start of the next that belong to one credential.
SCOPE = 256
# The three strong patterns; an access key or hex run too short for them is no match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: kind: (pattern, group and least length of what it must hold, role). The order of kinds is that of equal starts.
KINDS = {
    "assign": (ASSIGN, 2, 8, "secret"),
    "access": (ACCESS, 0, 1, "identifier"),
    "hex": (HEX, 0, 1, "secret"),
    "weak_identifier": (r"""(?<![A-Za-z0-9])(?:(?:AKIA[A-Z0-9]{1,11}(?![A-Z0-9]))|(?i:user(?:name|_?id)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,})""", 0, 1, "identifier"),
    "weak_secret": (r"""(?<![A-Za-z0-9])(?:(?i:pwd|pass|passphrase|private_?key|auth)["']?\x20*[:=]\x20*["']?[^\x20\x09-\x0D"']{4,}|(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{16,31}(?![A-Za-z0-9]))""", 0, 1, "secret"),
    "endpoint": (r"""(?i:https?|ftp|ssh|jdbc:[a-z0-9]+|postgres|mysql|mongodb|redis)://[^\x20\x09-\x0D"'<>]+|(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9])""", 0, 1, "endpoint"),
}
STRONG = ("assign", "access", "hex")


def _matches(text: str):
    """Per pattern the lengths of gaps and of matches in order, and whether each match counts."""
    found = []
    for i, (pattern, group, least, _) in enumerate(KINDS.values()):
        p, body = F.lit(pattern), F.col(text)
        sizes = F.transform(F.regexp_extract_all(body, p, F.lit(0)), F.length)
        gaps = F.slice(F.transform(F.split(body, pattern, -1), F.length), 1, F.size(sizes))
        holds = F.transform(F.transform(F.regexp_extract_all(body, p, F.lit(group)), F.length), F.lit(least).__le__)
        zipped = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), holds.alias("holds"))
        none = F.array().cast("array<struct<gap:int,size:int,holds:boolean>>")
        found.append(F.struct(F.lit(i).alias("kind"), F.when(body.rlike(pattern), zipped).otherwise(none).cast(
            "array<struct<gap:int,size:int,holds:boolean>>").alias("parts")))
    return F.filter(F.array(*found), lambda x: F.size(x["parts"]) > 0)


def link(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts (row, kind, start, end) that have a complementary part within ``scope`` code points."""
    roles = F.array(*(F.lit(k[3]) for k in KINDS.values()))
    covered = lambda beside: F.explode(F.sequence(F.floor(F.col("start") / scope) - beside, F.floor(F.col("end") / scope) + beside))
    parts = parts.withColumn("role", F.element_at(roles, F.col("kind") + 1))
    w = parts.where(F.col("kind") >= len(STRONG)).withColumn("stretch", covered(1)).alias("w")
    o = parts.withColumn("stretch", covered(0)).alias("o")
    near = (F.col("w.row") == F.col("o.row")) & (F.col("w.stretch") == F.col("o.stretch")) & (F.col("w.role") != F.col("o.role")) & (
        F.greatest("w.start", "o.start") - F.least("w.end", "o.end") <= scope)
    return w.join(o, near, "left_semi").select("row", "kind", "start", "end").distinct()


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    found = stash(scanned(docs).select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"),
                                       text_or_empty(text).alias("_text")).select("row", "doc_id", _matches("_text").alias("found")), "secret-matches")
    each = (found.select("row", F.explode("found").alias("f")).select("row", "f.kind", F.posexplode("f.parts").alias("at", "m"))
            .select("row", "kind", "at", "m.gap", "m.size", "m.holds"))
    upto = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("gap") + F.col("size")).cast("long")).over(upto)
    parts = stash(each.withColumn("end", end).where("holds").select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end"), "secret-parts")
    strong = F.col("kind") < len(STRONG)
    names = F.array(*(F.lit(k) for k in KINDS))
    spell = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    spans = (parts.where(strong).select("row", "kind", "start", "end").union(link(parts, scope)).groupBy("row").agg(
        *(F.sum((F.col("kind") == i).cast("long")).alias(f"n_{k}") for i, k in enumerate(STRONG)),
        F.sum((~strong).cast("long")).alias("n_linked"),
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("all")))
    joined = lambda a: F.concat_ws(",", F.transform(a, spell))
    base = F.filter("all", lambda s: s["kind"] < len(STRONG))
    none = F.lit(0).cast("long")
    return found.select("row", "doc_id").join(spans, "row", "left").select(
        "doc_id", *(F.coalesce(f"n_{k}", none).alias(f"n_{k}") for k in STRONG),
        F.sha2(F.coalesce(joined(base), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(joined(F.col("all")), F.lit("")).alias("spans"), F.coalesce("n_linked", none).alias("n_linked"))
