"""The four parts end to end, on DataFrames: groups, order, orientation of small scaffolds, joined sequences. Maps and groups run in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bintangle.operators import cuts, emit, graph, matrix, order, orient, vote
from bintangle.plans.config import Config
from bintangle.session import durable, join_dictionary
from bintangle.sources.maps import symmetric


def ordered_map(bins: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clustered places of the bins that have contacts (``map_id``, ``bin_id``, ``pos``), their number, and the symmetric cells at those places."""
    kept = matrix.keep_rows(bins, symmetric(cells))
    places = durable(matrix.positions(kept))
    n_bins = places.groupBy("map_id").agg(F.count("*").alias("n"))
    at = matrix.gather(cells, places, both=True)
    leaves = graph.leaf_order(n_bins, matrix.distances(at))
    new = durable(places.withColumnRenamed("pos", "at").join(leaves, ["map_id", "at"]).select("map_id", "bin_id", "pos"))
    return new, n_bins, matrix.gather(cells, new, both=True)


def sizes_of(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """``scaffold``, ``size`` of every scaffold of ``rows``, null where it is not known."""
    return rows.select("scaffold").distinct().join(sizes.select("scaffold", "size"), "scaffold", "left")


def cut_groups(places: DataFrame, n_bins: DataFrame, at: DataFrame, cells: DataFrame, config: Config) -> DataFrame:
    """``map_id``, ``bin_id``, ``pos``, ``group_id`` of an ordered map (see :func:`ordered_map`): cut by the strategy, and what lies behind the last cut by communities."""
    if config.strategy == "states":
        found = graph.state_cuts(n_bins, matrix.log_cells(at), config.min_size, config.convergence_rounds, config.look_ahead, config.modularity)
    else:
        found = cuts.find_cuts(n_bins, at, config.min_size, config.modularity, config.psig)
    found = durable(found)
    if config.modularity <= 0:
        return cuts.groups_from_cuts(places, found)
    logs = matrix.log_cells(cells).select("map_id", "i", "j", F.col("lg").alias("v"))
    return graph.tail_cuts(places, matrix.keep_cells(logs, places), found, config.restarts)


def assign_groups(grouped: DataFrame, bins: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The votes of the grouped bins, and ``map_id``, ``group_id`` (by falling size), ``scaffold``, ``bin_id``, ``sized`` of the assigned scaffolds. Only bins that are in a group count."""
    kept = durable(bins.join(grouped.select("bin_id"), "bin_id", "left_semi").select("map_id", "bin_id", "scaffold"))
    tallied = durable(vote.tally(grouped, kept))
    assigned = durable(vote.assigned_bins(tallied, kept))
    known = durable(sizes_of(assigned, sizes))
    chroms = vote.rank_groups(assigned, known.fillna(0, "size"))
    assigned = assigned.join(known.select("scaffold", F.col("size").isNotNull().alias("sized")), "scaffold")
    return tallied, assigned.join(chroms.select("map_id", "group_id", "chrom"), ["map_id", "group_id"]).select("map_id", F.col("chrom").cast("bigint").alias("group_id"), "scaffold", "bin_id", "sized")


def find_groups(bins: DataFrame, cells: DataFrame, sizes: DataFrame, config: Config) -> DataFrame:
    """Part 1: ``map_id``, ``group_id`` (by falling size), ``scaffold``, ``bin_id``, ``sized``. Scaffolds of unknown size are grouped like all others, but add nothing to the size of their group; their rows have ``sized`` false."""
    places, n_bins, at = ordered_map(bins, cells)
    return assign_groups(durable(cut_groups(places, n_bins, at, cells, config)), bins, sizes)[1]


def order_scaffolds(assigned: DataFrame, cells: DataFrame, config: Config) -> DataFrame:
    """Part 2, over all maps."""
    return order.order_groups(assigned, cells, config.first_scaffolds, config.scan_scaffolds)


def mark_small(ordered: DataFrame, sizes: DataFrame, config: Config, widths: DataFrame | None = None) -> DataFrame:
    """``ordered`` with ``resolution`` and ``is_small``: a scaffold of one bin. ``widths`` (``map_id``, ``resolution``) has the bin width of each map, else that of ``config`` holds for all."""
    wide = join_dictionary(ordered, widths, "map_id") if widths is not None else ordered.withColumn("resolution", F.lit(config.resolution).cast("bigint"))
    known = sizes.select("scaffold", "size")
    return wide.join(known, "scaffold", "left").withColumn("is_small", F.coalesce(F.ceil(F.col("size") / F.col("resolution")) == 1, F.lit(False))).drop("size")


def orient_scaffolds(ordered: DataFrame, sizes: DataFrame, sites: DataFrame, pairs: DataFrame, config: Config, widths: DataFrame | None = None) -> DataFrame:
    """Part 3, over all maps: what part 2 gave, with small scaffolds turned. Scaffolds of unknown size stay as they are."""
    return orient.orient_small(mark_small(ordered, sizes, config, widths), sizes_of(ordered, sizes), sites, pairs, config.length_cutoff, config.resolution)


def join_sequences(ordered: DataFrame, sequences: DataFrame) -> DataFrame:
    """Part 4: ``name``, ``line_no``, ``line`` of the joined sequences and the ones left over; with ``map_id``, of each map."""
    named = ordered.withColumnRenamed("scaffold", "name")
    of_map = [c for c in ("map_id",) if c in ordered.columns]
    joined = emit.join_lines(emit.oriented(named, sequences)).select(*of_map, F.concat(F.lit("Chr_"), F.col("group_id").cast("string")).alias("name"), "line_no", "line")
    left = emit.leftovers(named, sequences).select(*of_map, F.col("name").alias("group_id"), "ord", "seq")
    return joined.unionByName(emit.join_lines(left).select(*of_map, F.col("group_id").alias("name"), "line_no", "line"))
