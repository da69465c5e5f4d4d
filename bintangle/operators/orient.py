"""Orientation of small scaffolds from read pairs with their neighbours, normalised by cut sites.

All counts an orientation can need are aggregated first, for both orientations of the neighbour. The orientation of a small scaffold depends on the one its left neighbour got
before: so for each scaffold both answers are computed, and running windows put them together: the last scaffold whose answers are equal settles those behind it, and each scaffold
that turns against its left neighbour in either case changes it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bintangle.session import durable, join_dictionary


def group_keys(df: DataFrame) -> list[str]:
    """What a group is told by: groups are numbered from 1 in every map, so ``map_id`` belongs to the key where it is given."""
    return [c for c in ("map_id", "group_id") if c in df.columns]


def _cutoff_column(df: DataFrame) -> list[str]:
    return [c for c in ("cutoff",) if c in df.columns]


def neighbours(ordered: DataFrame) -> DataFrame:
    """Small scaffolds with the ones beside them: the group's keys, ``ord``, ``scaffold``, ``left``, ``right`` and ``cutoff`` if given; a lone scaffold gives none. ``ordered`` has ``is_small``."""
    keys = group_keys(ordered)
    w = Window.partitionBy(*keys).orderBy("ord")
    beside = ordered.withColumns({"left": F.lag("scaffold").over(w), "right": F.lead("scaffold").over(w)})
    return beside.where("is_small AND (left IS NOT NULL OR right IS NOT NULL)").select(*keys, "ord", "scaffold", "left", "right", *_cutoff_column(ordered))


def pair_keys(triplets: DataFrame) -> DataFrame:
    """The directed pairs of neighbours, both directions: ``s1``, ``s2`` and ``cutoff`` if given."""
    cutoff = _cutoff_column(triplets)
    sides = triplets.select("scaffold", *cutoff, F.explode(F.array("left", "right")).alias("other")).where("other IS NOT NULL")
    return sides.select(*cutoff, F.explode(F.array(F.struct(F.col("scaffold").alias("s1"), F.col("other").alias("s2")), F.struct(F.col("other").alias("s1"), F.col("scaffold").alias("s2")))).alias("k")).select("k.*", *cutoff).distinct()


def edge_sites(sites: DataFrame, sizes: DataFrame, cutoff: Column) -> DataFrame:
    """``scaffold`` (and ``cutoff`` if given), ``res_left``, ``res_right``: cut sites within ``cutoff`` of either end, at least 1; one that is in both counts left only."""
    df = sites.join(sizes.select("scaffold", "size"), "scaffold")
    left = F.size(F.filter("coords", lambda c: c <= cutoff))
    right = F.size(F.filter("coords", lambda c: (c > cutoff) & (c > F.col("size") - cutoff)))
    return df.select("scaffold", *_cutoff_column(df), F.greatest(left, F.lit(1)).alias("res_left"), F.greatest(right, F.lit(1)).alias("res_right"))


def length_cutoff(cutoff: int, resolution: int) -> int:
    """At least the resolution."""
    return max(cutoff, resolution)


def link_counts(keys: DataFrame, pairs: DataFrame, sizes: DataFrame, cutoff: int) -> DataFrame:
    """Of each directed key (``a``, ``b``, ``cutoff``): links as b is approached from a. Keys without a ``cutoff`` of their own have the given one.

    ``n_start``, ``n_end``: links within ``cutoff`` of the start or end of b. ``n_far_*``, ``n_near_*``: those whose place in a is in its second or first half. Pairs
    delivered as (a, b) are used if there are any, otherwise those delivered as (b, a), never both.
    """
    size = sizes.select("scaffold", "size")
    both = pairs.select(F.col("s1").alias("a"), F.col("p1").alias("pa"), F.col("s2").alias("b"), F.col("p2").alias("pb"), F.lit(1).alias("forward")).unionByName(
        pairs.select(F.col("s2").alias("a"), F.col("p2").alias("pa"), F.col("s1").alias("b"), F.col("p1").alias("pb"), F.lit(0).alias("forward"))
    )
    asked = durable(keys.select(F.col("s1").alias("a"), F.col("s2").alias("b"), *(_cutoff_column(keys) or [F.lit(cutoff).cast("bigint").alias("cutoff")])))
    cutoff = F.col("cutoff")
    sized = join_dictionary(both, asked, ["a", "b"])
    for end in ("a", "b"):
        sized = join_dictionary(sized, size.select(F.col("scaffold").alias(end), F.col("size").alias(f"size_{end}")), end)
    start, end = F.col("pb") <= cutoff, F.col("size_b") - F.col("pb") <= cutoff
    at_start, at_end = F.col("pb").between(F.lit(0), cutoff), F.col("pb").between(F.col("size_b") - cutoff, F.col("size_b"))
    far = F.col("pa") >= F.col("size_a") / 2
    per_way = sized.groupBy("a", "b", "cutoff", "forward").agg(
        F.count("*").alias("n"), F.count_if(start).alias("n_start"), F.count_if(end).alias("n_end"),
        F.count_if(far & at_start).alias("n_far_start"), F.count_if(~far & at_start).alias("n_near_start"), F.count_if(far & at_end).alias("n_far_end"), F.count_if(~far & at_end).alias("n_near_end"),
    )
    used = per_way.groupBy("a", "b", "cutoff").agg(F.max_by(F.struct("n", "n_start", "n_end", "n_far_start", "n_near_start", "n_far_end", "n_near_end"), "forward").alias("x"))
    return asked.join(used, ["a", "b", "cutoff"], "left").select("a", "b", "cutoff", "x.*").fillna(0)


def orient_small(ordered: DataFrame, sizes: DataFrame, sites: DataFrame, pairs: DataFrame, cutoff: int = 500_000, resolution: int = 500_000) -> DataFrame:
    """The group's keys, ``ord``, ``scaffold``, ``orientation``: the order with small scaffolds turned towards the neighbour they share more links with.

    ``ordered``: ``group_id``, ``ord``, ``scaffold``, ``orientation``, ``is_small``; ``map_id`` and ``resolution`` where there are several maps. A scaffold between two others compares
    links to the facing ends, over cut sites; one at an end compares its halves. Ties are +. A scaffold that is not in ``sizes`` is an error; one whose size is null keeps its
    orientation, and has no links with its neighbours.
    """
    keys = group_keys(ordered)
    own_cutoff = F.greatest(F.lit(cutoff), F.col("resolution")) if "resolution" in ordered.columns else F.lit(length_cutoff(cutoff, resolution))
    ordered = durable(ordered.withColumn("cutoff", own_cutoff.cast("bigint")))
    triplets = durable(neighbours(ordered))  # as the links and sites of the ends, read several times
    known = sizes.where("size IS NOT NULL")
    links = durable(link_counts(pair_keys(triplets), pairs, known, cutoff))
    every = sites.join(ordered.select("scaffold", "cutoff").distinct(), "scaffold")
    ends, halves = durable(edge_sites(every, known, F.col("cutoff"))), edge_sites(sites, known, F.col("size") / 2)
    side = lambda k, other: triplets.select(*keys, "ord", "cutoff", F.col("scaffold").alias("a"), F.col(other).alias("b")).join(links, ["a", "b", "cutoff"], "left").join(ends.select(F.col("scaffold").alias("b"), "cutoff", F.col("res_left").alias("o_left"), F.col("res_right").alias("o_right")), ["b", "cutoff"], "left").select(*keys, "ord", F.struct("n", "n_start", "n_end", "n_far_start", "n_near_start", "n_far_end", "n_near_end", "o_left", "o_right").alias(k))
    own = ends.select("scaffold", "cutoff", F.col("res_right").alias("r_right")).join(halves.select("scaffold", F.col("res_left").alias("h_left"), F.col("res_right").alias("h_right")), "scaffold")
    df = ordered.join(sizes.select("scaffold", F.lit(True).alias("_sized")), "scaffold", "left").withColumn("scaffold", F.when(F.col("_sized"), F.col("scaffold")).otherwise(F.raise_error(F.concat(F.lit("no size of scaffold "), "scaffold"))))
    df = df.join(own, ["scaffold", "cutoff"], "left").join(side("l", "left"), [*keys, "ord"], "left").join(side("r", "right"), [*keys, "ord"], "left")
    w = Window.partitionBy(*keys).orderBy("ord")
    rows = df.withColumns({"right": F.lead("orientation").over(w), "is_first": F.lag("ord").over(w).isNull(), "is_last": F.lead("ord").over(w).isNull()})
    right = F.col("right") == "+"
    facing_r = F.when(right, F.col("r.n_start") / (F.col("r_right") + F.col("r.o_left"))).otherwise(F.col("r.n_end") / (F.col("r_right") + F.col("r.o_right")))
    first_p = F.when(right, F.col("r.n_far_start") / (F.col("h_right") + F.col("r.o_left"))).otherwise(F.col("r.n_far_end") / (F.col("h_right") + F.col("r.o_right")))
    first_m = F.when(right, F.col("r.n_near_start") / (F.col("h_left") + F.col("r.o_left"))).otherwise(F.col("r.n_near_end") / (F.col("h_left") + F.col("r.o_right")))
    facing_l = {"-": F.col("l.n_start") / (F.col("r_right") + F.col("l.o_left")), "+": F.col("l.n_end") / (F.col("r_right") + F.col("l.o_right"))}
    last_p = {"+": F.col("l.n_near_end") / (F.col("l.o_right") + F.col("h_left")), "-": F.col("l.n_near_start") / (F.col("l.o_left") + F.col("h_left"))}
    last_m = {"+": F.col("l.n_far_end") / (F.col("l.o_right") + F.col("h_right")), "-": F.col("l.n_far_start") / (F.col("l.o_left") + F.col("h_right"))}
    at_least = lambda p, m: F.coalesce(p, F.lit(0.0)) >= F.coalesce(m, F.lit(0.0))

    def answer(left: str) -> Column:
        """The orientation if the left neighbour got ``left``."""
        plus = F.when(F.col("is_first"), at_least(first_p, first_m)).when(F.col("is_last"), at_least(last_p[left], last_m[left])).otherwise(at_least(facing_r, facing_l[left]))
        return F.when(F.col("is_small") & ~(F.col("is_first") & F.col("is_last")), F.when(plus, "+").otherwise("-")).otherwise(F.col("orientation"))

    both = rows.select(*keys, "ord", "scaffold", answer("+").alias("after_plus"), answer("-").alias("after_minus"))
    settled = F.col("after_plus").eqNullSafe(F.col("after_minus"))
    turns = F.sum(F.when(~settled & (F.col("after_plus") == "-"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    counted = both.withColumn("turns", turns)
    last = F.last(F.when(settled, F.struct(F.col("after_plus").alias("sign"), "turns")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    minus = (F.coalesce(F.col("last.sign"), F.lit("+")) == "-").cast("int") + F.col("turns") - F.col("last.turns")
    return counted.withColumn("last", last).select(*keys, "ord", "scaffold", F.when(settled, F.col("after_plus")).when(minus % 2 == 1, "-").otherwise("+").alias("orientation"))
