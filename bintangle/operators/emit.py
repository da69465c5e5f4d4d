"""Joined sequences of ordered scaffolds, in lines of fixed width.

A chromosome is never built as one text: each piece knows its offset, is cut at the line ends of the whole, and only lines that hold parts of several pieces are put
together. So chromosomes of any length are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bintangle.functions.special import reverse_complement
from bintangle.operators.orient import group_keys

#: Letters in a line, and Ns between two joined sequences.
WIDTH, GAP = 50, 100


def oriented(order: DataFrame, sequences: DataFrame) -> DataFrame:
    """The group's keys, ``ord``, ``name``, ``seq`` in reading direction; an ordered name without a sequence is an error."""
    joined = order.join(sequences.select("name", "seq", F.lit(True).alias("_there")), "name", "left")
    name = F.when(F.col("_there"), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("no sequence of "), "name")))
    return joined.select(*group_keys(order), "ord", name.alias("name"), F.when(F.col("orientation") == "-", reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))


def join_lines(pieces: DataFrame, width: int = WIDTH, gap: int = GAP) -> DataFrame:
    """The group's keys, ``line_no`` from 0, ``line``: the pieces (keys, ``ord``, ``seq``) of each group joined with gaps of N."""
    keys = group_keys(pieces)
    w = Window.partitionBy(*keys).orderBy("ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    length = F.length("seq")
    placed = pieces.withColumns({"_last": F.lead("ord").over(w).isNull(), "_from": F.coalesce(F.sum(length + gap).over(before), F.lit(0))})
    text = placed.withColumn("seq", F.when(F.col("_last"), F.col("seq")).otherwise(F.concat("seq", F.lit("N" * gap)))).where(F.length("seq") > 0)
    lines = text.select(*keys, "_from", "seq", F.explode(F.sequence(F.expr(f"_from div {width}"), F.expr(f"(_from + length(seq) - 1) div {width}"))).alias("line_no"))
    start = F.greatest(F.col("line_no") * width - F.col("_from"), F.lit(0))
    stop = F.least((F.col("line_no") + 1) * width - F.col("_from"), F.length("seq"))
    parts = lines.select(*keys, "line_no", F.struct("_from", F.substr("seq", (start + 1).cast("int"), (stop - start).cast("int")).alias("part")).alias("x"))
    return parts.groupBy(*keys, "line_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x.part), "").alias("line"))


def leftovers(order: DataFrame, sequences: DataFrame) -> DataFrame:
    """Sequences in no group: ``name``, ``seq``, ``ord``; with ``map_id``, those in no group of each map of the order."""
    if "map_id" in order.columns:
        used = order.groupBy("name").agg(F.collect_set("map_id").alias("_used"))
        every = order.agg(F.collect_set("map_id").alias("_maps"))  # one row
        unused = F.array_except("_maps", F.coalesce("_used", F.array().cast("array<int>")))
        return sequences.join(used, "name", "left").join(F.broadcast(every)).select(F.explode(unused).alias("map_id"), "name", "seq", "ord")
    return sequences.join(order.select("name"), "name", "left_anti").select("name", "seq", "ord")


def assembly_statistics(order: DataFrame, sequences: DataFrame, gap: int = GAP) -> DataFrame:
    """One row: joined and left sequences, their lengths, gaps and the Ns in them."""
    marked = sequences.join(order.select("name", "group_id", F.lit(True).alias("_in")), "name", "left")
    inside = F.col("_in").isNotNull()
    groups = order.agg(F.count_distinct("group_id").alias("n_groups"), F.count("*").alias("n_joined"))
    lengths = marked.agg(F.sum(F.when(inside, F.length("seq")).otherwise(0)).alias("joined_length"), F.count_if(~inside).alias("n_left"), F.sum(F.when(inside, 0).otherwise(F.length("seq"))).alias("left_length"))
    return groups.join(F.broadcast(lengths)).withColumn("n_gaps", F.col("n_joined") - F.col("n_groups")).withColumn("gap_ns", F.col("n_gaps") * gap)


def flat_order(scaffolds: DataFrame) -> DataFrame:
    """Bins in plotting order: ``group_id``, ``ord``, ``k``, ``scaffold``, ``bin_id``."""
    bins = F.when(F.col("orientation") == "-", F.reverse("bin_ids")).otherwise(F.col("bin_ids"))
    return scaffolds.select("map_id", "group_id", "ord", "scaffold", F.posexplode(bins).alias("k", "bin_id"))
