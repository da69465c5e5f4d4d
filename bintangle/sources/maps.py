"""Readers of the contact-map tables: bins with biases, contacts, sizes, cut sites, read pairs.

Each reader takes the delivered rows and gives a typed, de-duplicated relation. Order is a column (``ord``), never the place in a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bintangle.session import durable, join_dictionary, name_key, scaffold_names

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:inf|infinity|nan)$"


def parse_bias(text: Column) -> Column:
    """A bias: the number in the text, 0.0 if there is none."""
    plain = F.trim(text)
    return F.coalesce(F.when(plain.rlike(_NUMBER), F.expr("double(0)") + plain.try_cast("double")), F.lit(0.0))


def read_sizes(scaffold_sizes: DataFrame) -> DataFrame:
    """``scaffold``, ``size``: the last line of a name holds."""
    return scaffold_sizes.where("scaffold is not null").groupBy("scaffold").agg(F.max_by("size", "line_no").alias("size"))


def spell(df: DataFrame, column: str, scaffold_sizes: DataFrame, known_only: bool = False) -> DataFrame:
    """``df`` with the names in ``column`` written as in the sizes table; names that are not there stay, or go with ``known_only``."""
    names = scaffold_names(scaffold_sizes).select(F.col("key").alias("_key"), F.col("scaffold").alias("_name"))
    joined = join_dictionary(df.withColumn("_key", name_key(F.col(column))), names, "_key", "inner" if known_only else "left")
    return joined.withColumn(column, F.coalesce("_name", column)).drop("_key", "_name")


def read_bins(bins: DataFrame, biases: DataFrame, scaffold_sizes: DataFrame, allow: DataFrame | None = None) -> DataFrame:
    """Bins zipped by line with their biases: ``map_id``, ``bin_id``, ``scaffold``, ``start``, ``stop``, ``bias``, ``ord``.

    A bin whose bias is the text ``nan`` is dropped; a missing or unreadable bias is 0. ``allow`` (``bin_id``) keeps only those bins.
    """
    zipped = bins.join(biases.groupBy("line_no").agg(F.first("bias_txt").alias("bias_txt")), "line_no", "left").where(~F.col("bias_txt").eqNullSafe("nan"))
    if allow is not None:
        zipped = zipped.join(allow.select("bin_id").distinct(), "bin_id", "left_semi")
    out = zipped.select("map_id", "bin_id", "scaffold", "start", "stop", parse_bias(F.col("bias_txt")).alias("bias"), F.col("line_no").alias("ord"))
    return spell(out, "scaffold", scaffold_sizes)


def read_contacts(contacts: DataFrame, bins: DataFrame) -> DataFrame:
    """``map_id``, ``i`` <= ``j``, ``v``: the latest value of each unordered pair of known bins of one map; values that are not positive numbers are implicit zeros."""
    value = F.when(~F.isnan("v"), F.col("v"))
    pairs = contacts.where("b1 IS NOT NULL AND b2 IS NOT NULL").select(F.least("b1", "b2").alias("i"), F.greatest("b1", "b2").alias("j"), "loaded_at", value.alias("v"))
    # moved by i once: both the latest values and the merge with the bins of i are found where the rows are
    latest = pairs.repartition("i").groupBy("i", "j").agg(F.max(F.struct("loaded_at", "v")).alias("x")).select("i", "j", F.col("x.v").alias("v")).where("v > 0 AND v < double('infinity')")
    known = durable(bins.select("bin_id", "map_id"))
    n = known.count()
    both = join_dictionary(join_dictionary(latest, known.withColumnRenamed("bin_id", "i"), "i", rows=n, hot=False), known.select(F.col("bin_id").alias("j"), F.col("map_id").alias("_m")), "j", rows=n, hot=False)
    return both.where("map_id = _m").select("map_id", "i", "j", "v")


def symmetric(contacts: DataFrame) -> DataFrame:
    """Both directions of each contact, the diagonal once: ``map_id``, ``i``, ``j``, ``v``. The contacts are read once."""
    one, other = F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))
    return contacts.select("map_id", F.inline(F.when(F.col("i") == F.col("j"), F.array(one)).otherwise(F.array(one, other))), "v")


def bin_widths(bins: DataFrame) -> DataFrame:
    """``map_id``, ``resolution``: the bin width of each map. Only bins at the end of a scaffold are shorter."""
    return bins.groupBy("map_id").agg(F.max(F.col("stop") - F.col("start")).alias("resolution"))


def with_bin_count(sizes: DataFrame, resolution: int) -> DataFrame:
    """Sizes with the number of bins of a scaffold, and whether it is a small one."""
    return sizes.withColumn("bin_count", F.ceil(F.col("size") / F.lit(resolution)).cast("bigint")).withColumn("is_small", F.col("bin_count") == 1)


def read_sites(cut_sites: DataFrame, scaffold_sizes: DataFrame) -> DataFrame:
    """``scaffold``, ``coords``: the distinct cut coordinates of each known scaffold in order; empty where it has none."""
    sizes = read_sizes(scaffold_sizes)
    named = spell(cut_sites.where("coord IS NOT NULL").select("scaffold", "coord"), "scaffold", scaffold_sizes, known_only=True)
    return sizes.select("scaffold").join(named.groupBy("scaffold").agg(F.sort_array(F.collect_set("coord")).alias("coords")), "scaffold", "left").withColumn("coords", F.coalesce("coords", F.array().cast("array<bigint>")))


def read_pairs(valid_pairs: DataFrame, keys: DataFrame, scaffold_sizes: DataFrame) -> DataFrame:
    """``s1``, ``p1``, ``s2``, ``p2`` of the pairs whose directed (``s1``, ``s2``) is in ``keys``. The keys go first, so only their pairs are ever shuffled."""
    rows = valid_pairs.where("s1 IS NOT NULL AND s2 IS NOT NULL AND p1 IS NOT NULL AND p2 IS NOT NULL").select("s1", "p1", "s2", "p2")
    named = spell(spell(rows, "s1", scaffold_sizes, known_only=True), "s2", scaffold_sizes, known_only=True)
    wanted = keys.select(F.struct("s1", "s2").alias("_pair")).distinct()
    return join_dictionary(named.withColumn("_pair", F.struct("s1", "s2")), wanted, "_pair", "left_semi").select("s1", "p1", "s2", "p2")
