"""Scaffolds voted into groups by the majority of their bins, and the assessment of a grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Least percentage of a scaffold's bins that assigns it.
ASSIGN = 51.0


def scaffold_bins(bins: DataFrame) -> DataFrame:
    """``map_id``, ``scaffold``, its ``bin_ids`` in order and their number."""
    return bins.groupBy("map_id", "scaffold").agg(F.sort_array(F.collect_list("bin_id")).alias("bin_ids"), F.count("*").alias("node_count"))


def tally(grouped: DataFrame, bins: DataFrame) -> DataFrame:
    """``n_in`` of ``n_total`` bins of each scaffold in each group, ``pct`` and whether it is assigned there. ``grouped``: ``map_id``, ``bin_id``, ``group_id``."""
    total = bins.groupBy("map_id", "scaffold").agg(F.count("*").alias("n_total"))
    inside = grouped.join(bins.select("bin_id", "scaffold"), "bin_id").groupBy("map_id", "group_id", "scaffold").agg(F.count("*").alias("n_in"))
    pct = F.round(100.0 * F.col("n_in") / F.col("n_total"), 2)
    return inside.join(total, ["map_id", "scaffold"]).withColumn("pct", pct).withColumn("assigned", F.col("pct") >= ASSIGN)


def assigned_bins(tallied: DataFrame, bins: DataFrame) -> DataFrame:
    """All bins of each assigned scaffold, those that lay in other groups too: ``map_id``, ``group_id``, ``scaffold``, ``bin_id``."""
    return tallied.where("assigned").select("map_id", "group_id", "scaffold").join(bins.select("map_id", "scaffold", "bin_id"), ["map_id", "scaffold"]).select("map_id", "group_id", "scaffold", "bin_id")


def assess(tallied: DataFrame, bins: DataFrame) -> DataFrame:
    """Of each map: bins, bins of assigned scaffolds, bins found in a group their scaffold is not assigned to (``n_false``), and their share in per cent."""
    totals = bins.groupBy("map_id").agg(F.count("*").alias("n_bins"))
    votes = tallied.groupBy("map_id").agg(F.sum(F.when(F.col("assigned"), F.col("n_total")).otherwise(0)).alias("n_assigned"), F.sum(F.when(~F.col("assigned"), F.col("n_in")).otherwise(0)).alias("n_false"))
    return totals.join(votes, "map_id").withColumn("error_pct", F.round(100.0 * F.col("n_false") / F.col("n_bins"), 4))


def report_lines(tallied: DataFrame) -> DataFrame:
    """The assigned scaffolds as text: ``map_id``, ``group_id``, ``scaffold``, ``line``."""
    line = F.format_string("%s\t%d\t%d\t%.1f%%", "scaffold", "n_in", "n_total", "pct")
    return tallied.where("assigned").select("map_id", "group_id", "scaffold", line.alias("line"))


def assessment_lines(tallied: DataFrame, bins: DataFrame) -> DataFrame:
    """The whole assessment as text: ``map_id``, ``part``, ``at``, ``line``. A part for each group, with a head, all its scaffolds by name and two totals, and a last part (null) with those of the map."""
    text = lambda fmt, *cols: F.format_string(fmt, *cols)
    part = lambda df, at, line, *order: df.select("map_id", F.col("group_id").alias("part"), F.lit(at).alias("at"), F.concat_ws("/", *order).alias("by"), line.alias("line"))
    groups = tallied.groupBy("map_id", "group_id").agg(F.count("*").alias("n"), F.count_if("assigned").alias("n_assigned"))
    whole = assess(tallied, bins).join(groups.groupBy("map_id").agg(F.sum("n_assigned").alias("n_scaffolds")), "map_id").withColumn("group_id", F.lit(None).cast("bigint"))
    lines = [
        part(groups, 0, text("### Chromosome%d ###", "group_id")), part(groups, 1, F.lit("#Scaffold\tNodes assigned\tTotal nodes\tAssigned %")),
        part(tallied, 2, text("%s\t%d\t%d\t%.2f%%", "scaffold", "n_in", "n_total", "pct"), "scaffold"),
        part(groups, 3, text("Scaffolds with nodes in the group %d", "n")), part(groups, 4, text("Scaffolds assigned to the group %d", "n_assigned")),
        part(whole, 5, text("Total nodes %d", "n_bins")), part(whole, 6, text("Properly clustered nodes %d", F.col("n_bins") - F.col("n_false"))), part(whole, 7, text("Falsely clustered nodes %d", "n_false")),
        part(whole, 8, text("Scaffolds assigned %d", "n_scaffolds")), part(whole, 9, text("Error rate %.2f%%", "error_pct")),
    ]
    out = lines[0]
    for more in lines[1:]:
        out = out.unionByName(more)
    return out


def rank_groups(assigned: DataFrame, sizes: DataFrame) -> DataFrame:
    """``map_id``, ``group_id``, its base pairs and ``chrom``, its place by falling size from 1; ties keep the old order. A scaffold without a size is an error."""
    distinct = assigned.select("map_id", "group_id", "scaffold").distinct().join(sizes, "scaffold", "left")
    size = F.when(F.col("size").isNull(), F.raise_error(F.concat(F.lit("no size of scaffold "), "scaffold")).cast("bigint")).otherwise(F.col("size"))
    total = distinct.groupBy("map_id", "group_id").agg(F.sum(size).alias("bp"))
    return total.withColumn("chrom", F.row_number().over(Window.partitionBy("map_id").orderBy(F.desc("bp"), "group_id")))


def community_order(partition: DataFrame) -> DataFrame:
    """Communities by falling size, then first seen: ``map_id``, ``community``, ``n``, ``place``, and ``cut``, the place where it ends."""
    sized = partition.groupBy("map_id", "community").agg(F.count("*").alias("n"), F.min("pos").alias("first_seen"))
    w = Window.partitionBy("map_id").orderBy(F.desc("n"), "first_seen")
    return sized.withColumn("place", F.row_number().over(w)).withColumn("cut", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("first_seen")


def group_outlines(grouped: DataFrame) -> DataFrame:
    """``map_id``, ``group_id``, ``from_pos``, ``to_pos``: the square of each group on the plotted diagonal."""
    w = Window.partitionBy("map_id").orderBy("group_id")
    n = grouped.groupBy("map_id", "group_id").agg(F.count("*").alias("n"))
    ends = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return n.select("map_id", "group_id", (ends - F.col("n")).alias("from_pos"), ends.alias("to_pos"))
