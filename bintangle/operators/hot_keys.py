"""Per-key results although a few keys hold most records: dense accumulator arrays.

Keys are dictionary-encoded to numbers by a size-checked join. Every task then runs numpy ``bincount`` and scatter
reductions over its own equal share of the input, whatever the keys are, into blocks of ``BLOCK`` accumulators. The blocks are
summed in two rounds (by block and bucket, then by block), so no task ever holds the rows of one key and
none gets more blocks than its share. Sums are exact: values are added as two integers, of their lower ``LOW_BITS`` bits and of the others.

Defined cases: rows with a null or unknown key belong to no key and are only counted among all rows, in the same pass; null values
count as rows, not as values; an empty table gives no rows; keys of the dictionary without rows give a row of zeros with
null extremes; repeated rows count as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bintangle.session import durable, join_dictionary, number_rows

#: Accumulators in one block: 32 kB for each measure.
BLOCK = 4096
#: Blocks one task holds before it hands them on; bounds its memory at about 64 MB.
OPEN_BLOCKS = 400
#: Share of the first reduction round: blocks of the same number from different tasks go to so many buckets.
BUCKETS = 64
#: Bits of a value in its lower part, and rows that are added at once: sums of either part stay below 2**53, so ``bincount`` adds them exactly.
LOW_BITS, ROWS = 26, 1 << 15

_MEASURES = ["n", "n_value", "part_low", "part_high", "low", "high"]
_BLOCKS = ", ".join(["block bigint", "bucket int", *[f"{m} array<bigint>" for m in _MEASURES]])
_MOST, _LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


class _Accumulators:
    """One block: rows, values, the two parts of their sum, least and greatest, of each key number in it."""

    def __init__(self) -> None:
        self.n, self.n_value, self.part_low, self.part_high = (np.zeros(BLOCK, np.int64) for _ in range(4))
        self.low, self.high = np.full(BLOCK, _MOST), np.full(BLOCK, _LEAST)

    def add(self, at: np.ndarray, value: np.ndarray, known: np.ndarray) -> None:
        self.n += np.bincount(at, minlength=BLOCK)
        at, value = at[known], value[known]
        self.n_value += np.bincount(at, minlength=BLOCK)
        self.part_low += np.bincount(at, weights=value & ((1 << LOW_BITS) - 1), minlength=BLOCK).astype(np.int64)
        self.part_high += np.bincount(at, weights=value >> LOW_BITS, minlength=BLOCK).astype(np.int64)
        np.minimum.at(self.low, at, value)
        np.maximum.at(self.high, at, value)

    def merge(self, arrays: list[np.ndarray]) -> None:
        n, n_value, part_low, part_high, low, high = arrays
        self.n += n
        self.n_value += n_value
        self.part_low += part_low
        self.part_high += part_high
        np.minimum(self.low, low, out=self.low)
        np.maximum(self.high, high, out=self.high)

    def arrays(self) -> list[np.ndarray]:
        return [self.n, self.n_value, self.part_low, self.part_high, self.low, self.high]


def _batch(blocks: dict[int, _Accumulators], bucket: int) -> pa.RecordBatch:
    lists = [pa.array([b.arrays()[i] for b in blocks.values()], pa.list_(pa.int64())) for i in range(len(_MEASURES))]
    return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([bucket] * len(blocks), pa.int32()), *lists], names=["block", "bucket", *_MEASURES])


def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    bucket, blocks = TaskContext.get().partitionId() % BUCKETS, {}
    for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
        key = batch.column(0).to_numpy(zero_copy_only=False)
        known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
        value = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        block, at = key // BLOCK, key % BLOCK
        for b in np.unique(block):
            here = block == b
            blocks.setdefault(int(b), _Accumulators()).add(at[here], value[here], known[here])
        if len(blocks) > OPEN_BLOCKS:
            yield _batch(blocks, bucket)
            blocks = {}
    if blocks:
        yield _batch(blocks, bucket)


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum runs of equal (block, bucket); the rows come sorted by them."""
    at, acc = None, None
    for batch in batches:
        ids = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        lists = [batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, BLOCK) for i in range(2, 2 + len(_MEASURES))]
        for k, key in enumerate(ids):
            if key != at:
                if at is not None:
                    yield _batch({at[0]: acc}, at[1])
                at, acc = key, _Accumulators()
            acc.merge([x[k] for x in lists])
    if at is not None:
        yield _batch({at[0]: acc}, at[1])


def encode_keys(dictionary: DataFrame) -> DataFrame:
    """``key``, ``name``, ``key_id``: numbers from 0 without gaps in the order of the keys."""
    return number_rows(dictionary.select("key", "name"), "key", name="key_id")


def _cells(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``key_id`` and its measures; rows of null and unknown keys have the number -1."""
    coded = join_dictionary(rows.select("key", F.col("value").cast("bigint").alias("value")), names.select("key", "key_id"), "key", "left").select(F.coalesce("key_id", F.lit(-1)).alias("key_id"), "value")
    blocks = coded.mapInArrow(_accumulate, _BLOCKS)
    once = blocks.repartition("block", "bucket").sortWithinPartitions("block", "bucket").mapInArrow(_reduce, _BLOCKS)
    twice = once.withColumn("bucket", F.lit(0)).repartition("block").sortWithinPartitions("block").mapInArrow(_reduce, _BLOCKS)
    cells = twice.select("block", F.posexplode(F.arrays_zip(*_MEASURES)).alias("at", "x")).where("x.n > 0")
    total = F.expr(f"cast(cast(x.part_high AS decimal(19,0)) * cast({1 << LOW_BITS} AS decimal(8,0)) + cast(x.part_low AS decimal(19,0)) AS decimal(38,0))")
    return cells.select((F.col("block") * BLOCK + F.col("at")).alias("key_id"), "x.n", "x.n_value", total.alias("total"), "x.low", "x.high")


def _named(names: DataFrame, cells: DataFrame) -> DataFrame:
    extreme = lambda c: F.when(F.col("n_value") > 0, F.col(c)).alias(c)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return names.join(cells, "key_id", "left").select("name", zero("n"), zero("n_value"), F.coalesce("total", F.lit(0).cast("decimal(38,0)")).alias("total"), extreme("low"), extreme("high"))


def per_key(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Per key of ``dictionary`` (``key`` unique, ``name``): ``n``, ``n_value``, ``total``, ``low``, ``high`` over ``rows`` (``key``, ``value`` bigint)."""
    names = encode_keys(dictionary)
    return _named(names, _cells(rows, names))


def heavy_keys(rows: DataFrame, dictionary: DataFrame, share: float) -> DataFrame:
    """Keys that hold at least ``share`` of all rows, null and unknown keys included in all rows."""
    names = encode_keys(dictionary)
    cells = durable(_cells(rows, names))
    every = cells.agg(F.sum("n").alias("n_all"))
    return _named(names, cells).join(F.broadcast(every)).where((F.col("n") > 0) & (F.col("n") >= share * F.col("n_all"))).drop("n_all")
