"""De-duplication by the greedy two-key rule (DED-3).

DED-3, sequential definition: walk the rows in order; keep a row unless its
pair key or its url key was already registered by a *kept* row; a kept row
registers both keys. Skipped rows register nothing, so two independent
``row_number`` passes are not equivalent.

Distributed form (exact): the result is the lexicographically first
independent set of the conflict graph "shares pair or url".

1. Of rows sharing both keys only the first can ever be kept, so the candidates
   are one row per (pair, url), a map-side combined aggregation. They are
   numbered once by a range sort; from then on a row is three whole numbers: its
   rank and the least ranks of its pair and of its url, which name these groups.
2. Each round keeps every remaining row that is the first of both its groups,
   and removes all rows sharing a group with a kept one. Random data needs a
   handful of rounds.
3. What is left after PLAIN rounds may hold long chains, of which a round undoes
   one link. A row with exactly one earlier row in its groups together is kept if
   and only if that one is removed. Such rows point to their predecessors; the
   pointers are doubled, with the parity of the way, until each ends at a row with
   no earlier one (kept) or with several (open). So a chain of any length is
   settled in one round of log2(length) joins.

Each round's rows are checkpointed to the shared folder, so lineage stays short
and a lost executor recomputes one step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rounds without contraction of chains.
PLAIN = 4


def _checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint (folder from ``spark.checkpoint.dir``)."""
    from feedlake.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _ranked(cand: DataFrame) -> DataFrame:
    """``cand(_p, _u, _ord)`` with ``_r``, its rank by (_ord, _p, _u): the place in a range after the counts of the earlier ranges."""
    order = ["_ord", "_p", "_u"]
    dealt = _checkpoint(cand.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    offset = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_rank", rank).join(offset, "_part").select("_p", "_u", "_ord", (F.col("_before") + F.col("_rank")).alias("_r"))


def _chained(edges: DataFrame, firsts: DataFrame) -> DataFrame:
    """Ranks of rows that forced chains keep; ``firsts`` are the rows with no earlier one in their groups."""
    def second(side: str) -> DataFrame:
        rest = edges.join(edges.groupBy(side).agg(F.min("r").alias("m")), side).where("r > m")
        return rest.groupBy(side).agg(F.min("r").alias(f"{side}2"), F.min("m").alias(f"{side}1"))
    both = edges.join(second("a"), "a", "left").join(second("b"), "b", "left")
    in_a, in_b = F.coalesce(F.col("r") == F.col("a2"), F.lit(False)), F.coalesce(F.col("r") == F.col("b2"), F.lit(False))
    first_a = F.col("a1").isNull() | (F.col("r") == F.col("a1"))
    first_b = F.col("b1").isNull() | (F.col("r") == F.col("b1"))
    # one earlier row: the second of one group and the first of the other
    links = _checkpoint(both.select("r", F.when(in_a & first_b, F.col("a1")).when(in_b & first_a, F.col("b1")).alias("up"))
                        .where("up IS NOT NULL").withColumn("odd", F.lit(True)))
    while True:
        far = links.select(F.col("r").alias("up"), F.col("up").alias("far"), F.col("odd").alias("far_odd"))
        jumped = links.join(far, "up", "left")
        if jumped.where("far IS NOT NULL").isEmpty():
            break
        links = _checkpoint(jumped.select("r", F.coalesce("far", "up").alias("up"), (F.col("odd") != F.coalesce("far_odd", F.lit(False))).alias("odd")))
    return links.where("NOT odd").join(firsts.select(F.col("r").alias("up")), "up", "left_semi").select("r")


def greedy_two_key(df: DataFrame, order: Column, pair: Column, url: Column,
                   max_rounds: int | None = None, stats: dict | None = None) -> DataFrame:
    """DED-3: rows of ``df`` kept by the sequential two-key rule, in any order.

    ``order`` may be a struct (it compares field by field); rows of equal order
    are walked by their keys, and of wholly equal ones one counts. A NULL key
    counts as the empty text, a NULL order comes first. ``stats`` receives the
    round count.
    """
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = df.withColumn("_p", text(pair)).withColumn("_u", text(url)).withColumn("_ord", order)
    cand = rows.groupBy("_p", "_u").agg(F.min("_ord").alias("_least"), F.count_if(F.col("_ord").isNull()).alias("_none")).select(
        "_p", "_u", F.when(F.col("_none") == 0, F.col("_least")).alias("_ord"))
    ranked = _checkpoint(_ranked(cand))
    name = lambda side, to: ranked.groupBy(side).agg(F.min("_r").alias(to))
    edges = _checkpoint(ranked.select("_p", "_u", F.col("_r").alias("r")).join(name("_p", "a"), "_p").join(name("_u", "b"), "_u").select("r", "a", "b"))
    kept, rounds = [], 0
    while not edges.isEmpty():
        rounds += 1
        if max_rounds is not None and rounds > max_rounds:
            raise RuntimeError(f"greedy_two_key: more than {max_rounds} rounds")
        first = lambda side: edges.groupBy(side).agg(F.min("r").alias(f"m{side}"))
        firsts = _checkpoint(edges.join(first("a"), "a").join(first("b"), "b").where("r = ma AND r = mb").select("r", "a", "b"))
        found = firsts
        if rounds > PLAIN:
            found = _checkpoint(firsts.union(edges.join(_chained(edges, firsts), "r", "left_semi").select("r", "a", "b")))
        kept.append(found.select("r"))
        edges = _checkpoint(edges.join(found.select("a"), "a", "left_anti").join(found.select("b"), "b", "left_anti"))
    if stats is not None:
        stats["rounds"] = rounds
    out = ["_ord", "_p", "_u"]
    if not kept:
        return rows.limit(0).drop(*out)
    chosen = kept[0]
    for k in kept[1:]:
        chosen = chosen.union(k)
    # a kept candidate's keys and order name its rows; of wholly equal ones one is taken
    mine = ranked.join(chosen.select(F.col("r").alias("_r")), "_r", "left_semi").select(F.col("_p").alias("_kp"), F.col("_u").alias("_ku"), F.col("_ord").alias("_ko"))
    same = (F.col("_p") == F.col("_kp")) & (F.col("_u") == F.col("_ku")) & F.col("_ord").eqNullSafe(F.col("_ko"))
    return rows.join(mine, same, "left_semi").dropDuplicates(["_p", "_u"]).drop(*out)


def newest_first_order() -> Column:
    """A unique, comparable order key for 'newest first, NULL dates last, then id'."""
    return F.struct(F.col("posted_at").isNull().alias("a"),
                    (-F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"),
                                       F.col("posted_at"))).alias("b"),
                    F.col("source").alias("c"), F.col("external_id").alias("d"))
