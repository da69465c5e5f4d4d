"""The four parts from files to files. Each part reads what the parts before have written to the save directory, so parts can be run together or one by one.

A run is one map. The files between the parts hold one row for each bin or scaffold and are written as single text files; the joined sequences are written in part files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bintangle.operators import emit, order, orient, vote
from bintangle.plans import pipeline
from bintangle.plans.config import Config, missing
from bintangle.session import durable
from bintangle.sources import maps, text

MAP = 1
#: Names of the written files, each a folder with one text file (the sequences: several, in the order of their names).
FILES = {
    "leaves": "leaf_order", "bin_groups": "bin_groups", "assessment": "assessment", "groups": "chromosome_groups", "order": "chromosome_order", "plot": "plot_order", "final": "final_order", "fasta": "assembled_fasta",
}


def path_of(config: Config, name: str) -> str:
    return f"{config.save_directory.rstrip('/')}/{FILES[name]}"


def _in_map(df: DataFrame) -> DataFrame:
    return df.withColumn("map_id", F.lit(MAP))


def _sizes(spark: SparkSession, config: Config) -> DataFrame:
    return text.read_rows(spark, config.sizes_file, "scaffold_sizes").withColumnRenamed("at", "line_no")


def read_map(spark: SparkSession, config: Config, allow: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Bins with their biases, and cells; only the bins of ``allow`` if given. The last of repeated contacts holds."""
    cut = F.split("line", "\t")
    number = lambda k: F.get(cut, F.lit(k)).try_cast("bigint")
    lines = text.numbered_lines(spark, config.bed_file).where("line <> ''")
    bins = _in_map(lines.select("line_no", F.get(cut, F.lit(0)).alias("scaffold"), number(1).alias("start"), number(2).alias("stop"), number(3).alias("bin_id")))
    biases = text.numbered_lines(spark, config.bias_file).select("line_no", F.col("line").alias("bias_txt"))
    known = durable(maps.read_bins(bins, biases, _sizes(spark, config) if config.sizes_file else spark.createDataFrame([], "scaffold string"), allow))
    rows = text.read_rows(spark, config.matrix_file, "contacts").withColumnRenamed("at", "loaded_at")
    return known, durable(maps.read_contacts(rows, known))


def group(spark: SparkSession, config: Config) -> None:
    """Part 1: leaf order, groups of bins, assessment, groups of scaffolds by falling size."""
    bins, cells = read_map(spark, config)
    sizes = maps.read_sizes(_sizes(spark, config))
    places, n_bins, at = pipeline.ordered_map(bins, cells)
    named = bins.select("bin_id", "scaffold", "start", "stop", "bias", "ord")
    old = places.join(named, "bin_id").withColumn("at", F.row_number().over(Window.partitionBy("map_id").orderBy("ord", "bin_id")) - 1)
    text.write_lines(text.leaf_lines(old), path_of(config, "leaves"), "at")
    grouped = durable(pipeline.cut_groups(places, n_bins, at, cells, config))
    text.write_lines(text.section_lines(grouped.join(named.drop("ord"), "bin_id").withColumn("ord", F.col("pos")), ["bin_id", "scaffold", "start", "stop", "bias"]), path_of(config, "bin_groups"), "group_id", "at")
    tallied, assigned = pipeline.assign_groups(grouped, bins, sizes)
    kept = bins.join(grouped.select("bin_id"), "bin_id", "left_semi")
    text.write_lines(vote.assessment_lines(tallied, kept).withColumn("last", F.col("part").isNull()), path_of(config, "assessment"), "last", "part", "at", "by")
    text.write_lines(text.section_lines(assigned.withColumn("ord", F.col("bin_id")), ["bin_id", "scaffold"]), path_of(config, "groups"), "group_id", "at")


def order_groups(spark: SparkSession, config: Config) -> None:
    """Part 2: order and orientation of the scaffolds of each group, and the bins in plotting order."""
    lines = durable(text.numbered_lines(spark, path_of(config, "groups")))
    _, cells = read_map(spark, config, text.valid_bins(lines))
    assigned = durable(_in_map(text.read_groups(lines)).select("map_id", F.col("group_id").cast("bigint").alias("group_id"), "scaffold", "bin_id"))
    ordered = durable(pipeline.order_scaffolds(assigned, cells, config))
    text.write_lines(text.section_lines(ordered, ["scaffold", "orientation"], "Chromosome grouping"), path_of(config, "order"), "group_id", "at")
    built = order.group_scaffolds(assigned).drop("place").join(ordered.select("map_id", "group_id", "scaffold", "ord", "orientation"), ["map_id", "group_id", "scaffold"])
    flat = emit.flat_order(built).select("group_id", "ord", "k", F.concat_ws("\t", "scaffold", F.col("bin_id").cast("string")).alias("line"))
    head = spark.range(1).select(F.lit(0).cast("bigint").alias("group_id"), F.lit(0).alias("ord"), F.lit(0).alias("k"), F.lit("#Scaffold\tBin").alias("line"))
    text.write_lines(head.unionByName(flat), path_of(config, "plot"), "group_id", "ord", "k")


def orient_small(spark: SparkSession, config: Config) -> None:
    """Part 3: small scaffolds turned by their read pairs."""
    ordered = durable(text.read_order(text.numbered_lines(spark, path_of(config, "order"))))
    table = _sizes(spark, config)
    sizes = maps.read_sizes(table)
    marked = pipeline.mark_small(ordered, sizes, config)
    pairs = durable(maps.read_pairs(text.read_table(spark, config.pairs_file, "valid_pairs"), orient.pair_keys(orient.neighbours(marked)), table))
    sites = maps.read_sites(text.read_table(spark, config.sites_file, "cut_sites"), table)
    final = pipeline.orient_scaffolds(ordered, sizes, sites, pairs, config)
    text.write_lines(text.section_lines(final, ["scaffold", "orientation"], "Chromosome grouping"), path_of(config, "final"), "group_id", "at")


def write_assembly(spark: SparkSession, config: Config) -> None:
    """Part 4: the joined sequences by group, then those left over in the order of their file."""
    ordered = durable(text.read_order(text.numbered_lines(spark, path_of(config, "final"))))
    sequences = durable(text.read_fasta(spark, config.fasta_file))
    named = ordered.withColumnRenamed("scaffold", "name")
    joined = emit.join_lines(emit.oriented(named, sequences)).select(F.concat(F.lit("Chr_"), F.col("group_id").cast("string")).alias("name"), F.lit(0).alias("rest"), F.col("group_id").cast("bigint").alias("place"), "line_no", "line")
    left = emit.leftovers(named, sequences).select(F.col("name").alias("group_id"), F.col("ord").alias("place"), F.lit(1).alias("ord"), "seq")
    rest = emit.join_lines(left.select("group_id", "ord", "seq")).join(left.select("group_id", "place"), "group_id").select(F.col("group_id").alias("name"), F.lit(1).alias("rest"), "place", "line_no", "line")
    text.write_fasta(joined.unionByName(rest), path_of(config, "fasta"), "rest", "place")


PARTS = {1: group, 2: order_groups, 3: orient_small, 4: write_assembly}


def run(spark: SparkSession, config: Config, parts: tuple[int, ...] = (1, 2, 3, 4)) -> None:
    """The chosen parts, in order. Settings they need and that are not set are an error before anything is read."""
    lacking = missing(config, parts)
    if not config.save_directory:
        lacking.append("save_directory")
    if lacking:
        raise ValueError(f"settings missing: {', '.join(lacking)}")
    for part in sorted(set(parts)):
        PARTS[part](spark, config)
