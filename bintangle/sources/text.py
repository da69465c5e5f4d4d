"""Text formats at the edges: tab-separated tables, sectioned files, FASTA. Inside, tables with explicit ``group_id`` and ``ord`` are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bintangle.session import durable, number_rows

SCHEMAS = {
    "bins": "scaffold string, start long, stop long, bin_id long",
    "contacts": "b1 long, b2 long, v double",
    "scaffold_sizes": "scaffold string, size long",
    "cut_sites": "scaffold string, _start long, coord long, site string, strand string",
    "valid_pairs": "read string, s1 string, p1 long, strand1 string, s2 string, p2 long, strand2 string",
}


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A delivered tab-separated file with its fixed columns; gzip files are read too."""
    return spark.read.csv(path, sep="\t", schema=SCHEMAS[kind], quote="", mode="PERMISSIVE", ignoreTrailingWhiteSpace=True)


def _file_order() -> Column:
    """Where a row of one file stands: the start of its split, then its place in it."""
    return F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no`` from 1, ``line`` of a file, without its carriage return."""
    rows = spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("line"), _file_order().alias("at"))
    return number_rows(rows, "at", name="line_no").select((F.col("line_no") + 1).alias("line_no"), "line")


def read_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of a delivered file with their place in it (``at``)."""
    return read_table(spark, path, kind).select("*", _file_order().alias("at"))


def sections(lines: DataFrame, keys: list[str] | None = None, order: str = "line_no", header: str = "#") -> DataFrame:
    """``lines`` without header lines, with ``section``: how many header lines of the same ``keys`` come before; lines before the first have 0.

    Without ``keys`` the lines are one file: it is sorted in ranges, headers are counted in each, and only the counts of the ranges are gathered.
    """
    is_header = F.col("line").startswith(header)
    count = F.sum(F.when(is_header, 1).otherwise(0))
    if keys:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return lines.withColumn("section", count.over(w)).where(~is_header)
    placed = durable(lines.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    before, n = {}, 0
    for part, heads in sorted((r[0], r[1]) for r in placed.groupBy("__part").agg(count).collect()):
        before[part], n = n, n + heads
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("__part")] if before else F.lit(0)
    w = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn("section", (count.over(w) + offset).cast("bigint")).where(~is_header).drop("__part")


def read_groups(lines: DataFrame) -> DataFrame:
    """A file of bin groups: ``group_id``, ``ord``, ``bin_id``, ``scaffold``."""
    cut = F.split("line", "\t")
    return sections(lines).select(F.col("section").alias("group_id"), F.col("line_no").alias("ord"), F.get(cut, F.lit(0)).try_cast("bigint").alias("bin_id"), F.get(cut, F.lit(1)).alias("scaffold"))


def read_order(lines: DataFrame) -> DataFrame:
    """A file of ordered scaffolds: ``group_id``, ``ord`` from 1, ``scaffold``, ``orientation``."""
    cut = F.split("line", "\t")
    df = sections(lines).select(F.col("section").alias("group_id"), "line_no", F.get(cut, F.lit(0)).alias("scaffold"), F.get(cut, F.lit(1)).alias("orientation"))
    return df.select("group_id", F.row_number().over(Window.partitionBy("group_id").orderBy("line_no")).alias("ord"), "scaffold", "orientation")


def valid_bins(lines: DataFrame) -> DataFrame:
    """The distinct bins of a file of groups."""
    return read_groups(lines).select("bin_id").distinct()


def leaf_lines(leaves: DataFrame) -> DataFrame:
    """``at``, ``line`` of a file of clustered leaves: label and old place, tab-separated, in their new order (``scaffold``, ``bin_id``, ``at`` the old place, ``pos`` the new one)."""
    return leaves.select(F.col("pos").alias("at"), F.concat_ws("\t", F.concat_ws("_", "scaffold", "bin_id"), F.col("at").cast("string")).alias("line"))


def read_leaves(lines: DataFrame) -> DataFrame:
    """A file of clustered leaves: ``pos`` from 0, ``label``, ``at`` (the last field)."""
    cut = F.split("line", "\t")
    return lines.where("line <> ''").select((F.col("line_no") - 1).alias("pos"), F.get(cut, F.lit(0)).alias("label"), F.element_at(cut, -1).try_cast("bigint").alias("at"))


def section_lines(rows: DataFrame, columns: list[str], title: str = "Chromosome group") -> DataFrame:
    """``group_id``, ``at``, ``line`` of a sectioned file: a header before the rows (``group_id``, ``ord``, ``columns``) of each group, tab-separated."""
    body = rows.select("group_id", F.col("ord").cast("bigint").alias("at"), F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("line"))
    heads = rows.select("group_id").distinct().select("group_id", F.lit(-1).cast("bigint").alias("at"), F.concat(F.lit(f"### {title} "), F.col("group_id").cast("string"), F.lit(" ###")).alias("line"))
    return heads.unionByName(body)


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    """One ordered text file. For files that are small by nature: orders and groups of scaffolds."""
    lines.orderBy(*order).select("line").coalesce(1).write.mode("overwrite").text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``name`` (the whole header), ``seq``, ``ord``; of repeated names the last one holds. Gzip is told by the file name. Records split across tasks by their separator."""
    records = spark.read.text(path, lineSep="\n>").withColumn("_at", F.monotonically_increasing_id())
    text = F.regexp_replace("value", r"^\s*>|\r", "")
    parsed = records.select("_at", F.trim(F.substring_index(text, "\n", 1)).alias("name"), F.regexp_replace(F.when(F.instr(text, "\n") > 0, F.substr(text, F.instr(text, "\n") + 1)).otherwise(""), r"\s", "").alias("seq"))
    last = parsed.where("name <> '' OR seq <> ''").groupBy("name").agg(F.max(F.struct("_at", "seq")).alias("x"))
    return last.select("name", F.col("x.seq").alias("seq"), F.col("x._at").alias("ord"))


def fasta_lines(named_lines: DataFrame, *order: str) -> DataFrame:
    """``order``, ``name``, ``at``, ``line`` of a FASTA file from ``name``, ``line_no``, ``line``; ``order`` is one for each name."""
    heads = named_lines.select(*order, "name").distinct().select(*order, "name", F.lit(-1).cast("bigint").alias("at"), F.concat(F.lit(">"), "name").alias("line"))
    return heads.unionByName(named_lines.select(*order, "name", F.col("line_no").cast("bigint").alias("at"), "line"))


def write_fasta(named_lines: DataFrame, path: str, *order: str) -> None:
    """Part files in the order of ``order``, names and lines; concatenated in the order of their names they are one FASTA file."""
    by = [*order, "name", "at"]
    fasta_lines(named_lines, *order).repartitionByRange(*by).sortWithinPartitions(*by).select("line").write.mode("overwrite").text(path)
