"""Contact-matrix operators on sparse cells (``map_id``, ``i``, ``j``, ``v``); cells that are not there are zeros.

Zeros are never stored: a zero contact has distance 2, similarity 0 and logarithm 0, and its place in a rank follows from the counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bintangle.session import durable, join_dictionary

#: Parts of each power of two of the values, by which places are looked up.
PARTS = 64


def row_sums(cells: DataFrame) -> DataFrame:
    return cells.groupBy("map_id", "i").agg(F.sum("v").alias("row_sum"))


def keep_rows(bins: DataFrame, cells: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Bins whose row is not all zero and, with bounds, whose bias lies within them, bounds included."""
    kept = bins.join(row_sums(cells).where("row_sum <> 0").select(F.col("i").alias("bin_id")), "bin_id", "left_semi")
    return kept if low is None else kept.where(F.col("bias").between(low, high))


def keep_cells(cells: DataFrame, bins: DataFrame) -> DataFrame:
    """Cells both ends of which are among ``bins``."""
    kept = durable(bins.select("bin_id").distinct())
    n = kept.count()
    for end in ("i", "j"):
        cells = join_dictionary(cells, kept.select(F.col("bin_id").alias(end)), end, "left_semi", rows=n, hot=False)
    return cells


def distances(cells: DataFrame) -> DataFrame:
    """``d`` = 2 - v / row sum, not symmetric as each row is normalised by its own sum."""
    return cells.withColumn("d", 2 - F.col("v") / F.sum("v").over(Window.partitionBy("map_id", "i")))


def similarities(distance_cells: DataFrame, sums: DataFrame) -> DataFrame:
    """The inverse: ``s`` = row sum (2 - d)."""
    return distance_cells.join(sums, ["map_id", "i"]).withColumn("s", F.col("row_sum") * (2 - F.col("d")))


def log_cells(cells: DataFrame, base: float = 10.0, offset: float = 1.0) -> DataFrame:
    """``lg``: the logarithm of v + offset where v is not zero."""
    return cells.withColumn("lg", F.when(F.col("v") != 0, F.log(base, F.col("v") + offset)).otherwise(0.0))


def unlog_cells(log_df: DataFrame, base: float = 10.0, offset: float = 1.0) -> DataFrame:
    return log_df.withColumn("v", F.when(F.col("lg") != 0, F.pow(F.lit(base), F.col("lg")) - offset).otherwise(0.0))


def upper_triangle(cells: DataFrame) -> DataFrame:
    """The condensed form: cells above the diagonal; of a row-normalised value this is the one of the lesser bin."""
    return cells.where("i < j")


def positions(bins: DataFrame, order: str = "ord") -> DataFrame:
    """``map_id``, ``bin_id``, ``pos``: places from 0 within each map."""
    return bins.select("map_id", "bin_id", (F.row_number().over(Window.partitionBy("map_id").orderBy(order, "bin_id")) - 1).alias("pos"))


def gather(cells: DataFrame, places: DataFrame, both: bool = False) -> DataFrame:
    """Sub-matrix or permutation: cells renumbered to the places of their bins; cells of other bins go. Data never move, only numbers.

    With ``both``, ``cells`` has each pair once, and each is given in both directions, the diagonal once: they are mirrored behind the joins, so half as many rows are moved."""
    at = lambda k: places.select(F.col("bin_id").alias(k), F.col("pos").cast("bigint").alias(f"pos_{k}"))
    n = places.count()
    placed = join_dictionary(join_dictionary(cells, at("i"), "i", rows=n, hot=False), at("j"), "j", rows=n, hot=False)
    there, back = (F.struct(F.col(f"pos_{a}").alias("i"), F.col(f"pos_{b}").alias("j")) for a, b in ("ij", "ji"))
    if both:
        return placed.select("map_id", F.inline(F.when(F.col("i") == F.col("j"), F.array(there)).otherwise(F.array(there, back))), "v")
    return placed.select("map_id", F.col("pos_i").alias("i"), F.col("pos_j").alias("j"), "v")


def ranks(cells: DataFrame) -> DataFrame:
    """``k``: place of the non-zero cells of each row by falling value, from 0; ties by falling ``j``. All zeros come behind, by falling ``j``.

    These are the ranks of the similarities too, as similarity rises with contact in each row."""
    return cells.withColumn("k", F.row_number().over(Window.partitionBy("map_id", "i").orderBy(F.desc("v"), F.desc("j"))) - 1)


def clip_bounds(cells: DataFrame, n_bins: DataFrame, low: float = 0.01, high: float = 0.98) -> DataFrame:
    """Percentiles (linear between neighbours) over all N x N cells of each map, zeros included without making them.

    A place p (N*N - 1) in the sorted cells is zero as long as it is below the number of zeros; above, it is looked up among the non-zero cells (positive values): these are counted in parts of a
    power of two, and only the parts that hold a looked-up place are ranked.
    """
    size = n_bins.withColumn("cells", F.col("n") * F.col("n"))
    count = cells.groupBy("map_id").agg(F.count("*").alias("filled"))
    base = size.join(count, "map_id", "left").fillna(0, ["filled"]).withColumn("zeros", F.col("cells") - F.col("filled"))
    asked = base.withColumn("q", F.explode(F.array(F.lit(low), F.lit(high)))).withColumn("at", F.col("q") * (F.col("cells") - 1))
    ends = asked.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("place", F.least(F.floor("at") + F.col("side"), F.col("cells") - 1))
    asked = durable(ends.withColumn("r", F.col("place") - F.col("zeros") + 1))
    binned = cells.select("map_id", "v", F.floor(F.log2("v") * PARTS).alias("part"))
    upto = F.sum("n").over(Window.partitionBy("map_id").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    parts = binned.groupBy("map_id", "part").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).withColumn("before", upto - F.col("n"))
    hit = durable(asked.select("map_id", "q", "side", "r").join(parts, "map_id").where((F.col("r") > F.col("before")) & (F.col("r") <= F.col("before") + F.col("n"))).select("map_id", "q", "side", "r", "part", "low", "high", "before"))
    # only the parts that hold a looked-up place are ranked, and not if they hold a single value
    wanted = hit.where("low < high").select(F.struct("map_id", "part").alias("_part")).distinct()
    few = join_dictionary(binned.withColumn("_part", F.struct("map_id", "part")), wanted, "_part", "left_semi")
    ranked = few.select("map_id", "part", "v", F.row_number().over(Window.partitionBy("map_id", "part").orderBy("v")).alias("k"))
    looked_up = hit.withColumn("k", F.col("r") - F.col("before")).join(ranked, ["map_id", "part", "k"], "left").select("map_id", "q", "side", F.coalesce("v", "low").alias("v"))
    found = asked.join(looked_up, ["map_id", "q", "side"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    low_v, high_v = F.max(F.when(F.col("side") == 0, F.col("v"))), F.max(F.when(F.col("side") == 1, F.col("v")))
    part = F.max(F.col("at") - F.floor("at"))
    return found.groupBy("map_id", "q").agg((low_v + (high_v - low_v) * part).alias("bound"))


def plot_cells(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    """Cells of a heat map, clipped to the bounds of their map (``low``, ``high``)."""
    return cells.join(bounds, "map_id").withColumn("v", F.greatest(F.col("low"), F.least(F.col("high"), F.col("v")))).drop("low", "high")


def axis_ticks(n_bins: DataFrame, resolution: int, ticks: int = 11) -> DataFrame:
    """Evenly spread tick places of each map's axes with their label in megabases."""
    k = F.explode(F.sequence(F.lit(0), F.lit(ticks - 1))).alias("tick")
    place = F.floor(F.col("tick") * F.col("n") / F.lit(ticks - 1)).cast("bigint")
    return n_bins.select("map_id", "n", k).select("map_id", "tick", place.alias("at"), F.format_string("%.1f Mb", place * F.lit(resolution) / F.lit(1e6)).alias("label"))
