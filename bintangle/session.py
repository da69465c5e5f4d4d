"""Session helpers: table loading, durable cuts of lineage, size-checked dictionary joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

#: Largest dictionary, in rows, that is sent to every executor; beyond it the join is shuffled and salted.
MAX_BROADCAST_ROWS = 200_000
#: Copies of each dictionary row in the salted join.
SALTS = 32


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``; set a folder of our own only in local mode."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="bintangle-"))
    else:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage as :func:`durable` does, for many narrow rows: columns in files of the checkpoint folder, which take less room than checkpointed rows. They go when the session ends."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = spark._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"rows-{uuid.uuid4().hex}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(path.toString())
    return spark.read.schema(df.schema).parquet(path.toString())


def release(df: DataFrame) -> None:
    """Delete the files of checkpointed rows that nothing reads any more."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for k in range(leaves.size()):
        leaf = leaves.apply(k)
        if leaf.getClass().getSimpleName() == "LogicalRDD" and (file := leaf.rdd().getCheckpointFile()).isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def number_rows(df: DataFrame, *by: str, name: str = "number") -> DataFrame:
    """``df`` with numbers from 0 without gaps in the order of ``by``: rows are sorted in ranges, and only the sizes of the ranges are gathered. Rows of equal ``by`` are numbered in any order."""
    placed = durable(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__placed", F.monotonically_increasing_id()))
    part = F.shiftright("__placed", 33).cast("int")
    offsets, n = {}, 0
    for p, size in sorted((r[0], r[1]) for r in placed.groupBy(part.alias("_part")).count().collect()):
        offsets[p], n = n, n + size
    offset = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])[part] if offsets else F.lit(0)
    return placed.withColumn(name, (offset + F.col("__placed").bitwiseAND(F.lit(2**33 - 1))).cast("bigint")).drop("__placed")


def spread(df: DataFrame, *keys: str) -> GroupedData:
    """``df`` grouped by ``keys``, whole numbers, for a kernel whose work does not show in the size of its rows: over all shuffle partitions, which adaptive execution leaves as they are. Its columns are new ones, so it can be
    cogrouped with rows of the same origin."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(*[(F.col(c).cast("bigint") if c in keys else F.col(c)).alias(c) for c in df.columns]).repartition(parts, *keys).groupBy(*keys)


#: White space at the ends of a name; names are delivered with carriage returns and stray blanks.
_ENDS = r"^[\s\u00A0]+|[\s\u00A0]+$"


def name_key(name: Column) -> Column:
    """A name as it is compared: without white space at both ends, ignoring case."""
    return F.lower(F.regexp_replace(name, _ENDS, ""))


def join_dictionary(df: DataFrame, dictionary: DataFrame, on: str | list[str], how: str = "inner", max_rows: int = MAX_BROADCAST_ROWS, rows: int | None = None, hot: bool = True) -> DataFrame:
    """Join ``df`` to a dictionary with unique ``on`` values.

    The dictionary is counted (up to ``max_rows`` + 1) first. Within the bound it is broadcast, so hot keys cost
    nothing; ``rows``, if given, is that count. Beyond it, every dictionary row is copied ``SALTS`` times and ``df`` is salted, so a key that holds a third
    of all rows is spread over ``SALTS`` tasks. Where no key holds many rows (``hot`` false: a bin has one cell at most with each bin of its map), it is
    not copied. Beyond the bound Spark is told to merge, as it takes the copies for as small as the dictionary and would broadcast them. Each way gives the same rows.
    """
    if (dictionary.limit(max_rows + 1).count() if rows is None else rows) <= max_rows:
        return df.join(F.broadcast(dictionary), on, how)
    if not hot:
        return df.join(dictionary.hint("merge"), on, how)
    salted = df.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))  # by place, so equal rows are spread too
    copies = dictionary.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keys = [on] if isinstance(on, str) else on
    return salted.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def scaffold_names(scaffold_sizes: DataFrame) -> DataFrame:
    """``key``, ``scaffold``: each name of the sizes table once, as written there (the least spelling of equal keys)."""
    return scaffold_sizes.where("scaffold is not null").groupBy(name_key(F.col("scaffold")).alias("key")).agg(F.min("scaffold").alias("scaffold")).where("key <> ''")
