"""Items that appear together: pair counts by external sort of packed codes.

Each basket's pairs become 64-bit codes, ``a << 32 | b`` with ``a <= b``; the code of (a, a) counts the item, and one code counts baskets. Tasks sort their codes
in runs of ``RUN``, count run lengths and merge runs, so a code leaves a task once, or once for ``RUN`` others. Spark's shuffle spills the runs and merges them by code, and run lengths are added up. Baskets come
from a sort of the rows by basket, read as a stream, so no basket has to fit in memory: of a basket that spans batches only its distinct items are carried.
Of a basket of more than ``WIDE`` items, blocks of items leave the task instead of codes, two by two, and other tasks make the codes of each two blocks, so the pairs of one basket are spread over all tasks.

Before the shuffle every task merges rows of baskets that fill its batches into their distinct items, so a basket that holds a
third of all rows leaves each task as at most one row for each item.

Defined cases: rows with a null basket are left out, and so are unknown and null items, and baskets without items; an item counts once in a basket;
empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bintangle.session import durable, join_dictionary, number_rows

#: Rows of one basket in one batch from which its items are merged before the shuffle.
HOT = 32
#: (basket, item) entries a task holds before it hands them on.
HELD = 500_000
#: Codes a task sorts at once, and distinct codes it holds: 32 MB.
RUN = 4_000_000
#: Items of a basket whose pairs one task makes, and items of a block of a wider one.
WIDE, BLOCK = 4096, 1024
#: The code that counts baskets.
BASKET = -1
_ROWS = "basket string, item1 int, item2 int"
_COUNTS = "code bigint, n bigint"
_RUNS = f"{_COUNTS}, left array<int>, right array<int>"
_SCHEMA = pa.schema([("basket", pa.string()), ("item1", pa.int32()), ("item2", pa.int32())])


def _merge_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hot, held = defaultdict(set), 0

    def flush() -> pa.RecordBatch:
        rows = [(k, i) for k, items in hot.items() for i in sorted(items)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([i for _, i in rows], pa.int32()), pa.array([-1] * len(rows), pa.int32())], schema=_SCHEMA)

    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        often = np.flatnonzero(np.bincount(at, minlength=1) >= HOT)
        if len(often):
            item1, item2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            for k in often:
                here = at == k
                items = hot[coded.dictionary[int(k)].as_py()]
                held -= len(items)
                items.update(np.unique(np.concatenate([item1[here], item2[here]])).tolist())
                held += len(items)
            batch = batch.filter(pa.array(~np.isin(at, often)))
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays(batch.columns, schema=_SCHEMA)
        if held > HELD:
            yield flush()
            hot.clear()
            held = 0
    if hot:
        yield flush()


def _distinct_items(basket: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each known item of each basket once, in order."""
    order = np.lexsort((item, basket))
    basket, item = basket[order], item[order]
    first = np.ones(len(item), bool)
    first[1:] = (basket[1:] != basket[:-1]) | (item[1:] != item[:-1])
    first &= item >= 0
    return basket[first], item[first].astype(np.int64)


def _codes(basket: np.ndarray, item: np.ndarray, sizes: np.ndarray) -> Iterator[np.ndarray]:
    """The pair codes of complete baskets, a bounded part at a time. ``sizes``: items of each basket in order."""
    live = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    step = 1
    while len(live):  # each round pairs an item with the one `step` places on in its basket
        live = live[live + step < len(item)]
        live = live[basket[live] == basket[live + step]]
        yield item[live] << 32 | item[live + step]
        step += 1


def _run_lengths(codes: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.empty(0, np.int64)
    return codes[starts], np.add.reduceat(n, starts) if n is not None and len(starts) else np.diff(np.r_[starts, len(codes)])


class _Runs:
    """Sorted runs of a task, merged as long as they hold few distinct codes."""

    def __init__(self, run: int) -> None:
        self.run, self.fresh, self.n_fresh, self.n_baskets = run, [], 0, 0
        self.code, self.n = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.fresh.append(codes)
        self.n_fresh += len(codes)
        if self.n_fresh >= self.run:
            yield from self.merge(self.run)

    def merge(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take in what is fresh; hand the run on if it has more than ``most`` codes."""
        code, n = _run_lengths(np.sort(np.concatenate([*self.fresh, np.empty(0, np.int64)])))
        self.fresh, self.n_fresh = [], 0
        both, lengths = np.concatenate([self.code, code]), np.concatenate([self.n, n])
        order = np.argsort(both, kind="stable")
        self.code, self.n = _run_lengths(both[order], lengths[order])
        if len(self.code) > most:
            yield self.code, self.n
            self.code, self.n = np.empty(0, np.int64), np.empty(0, np.int64)

    def end(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.n_baskets:
            yield np.array([BASKET]), np.array([self.n_baskets])
        yield from self.merge(0)


def _counts(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])


_PIECES = pa.list_(pa.int32())


def _run_batch(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*_counts(codes, n).columns, pa.nulls(len(codes), _PIECES), pa.nulls(len(codes), _PIECES)], names=["code", "n", "left", "right"])


def _two_blocks(item: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """Rows of every two blocks of a wide basket, and of each block with itself."""
    parts = [item[k : k + block].astype(np.int32) for k in range(0, len(item), block)]
    for k, left in enumerate(parts):
        right = parts[k:]
        none = pa.nulls(len(right), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array([left] * len(right), _PIECES), pa.array(right, _PIECES)], names=["code", "n", "left", "right"])


def _sorted_runs(wide: int, block: int, run: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by basket to sorted runs of (code, length), and to two blocks each of wide baskets."""

    def complete(basket: np.ndarray, item: np.ndarray, runs: _Runs) -> Iterator[pa.RecordBatch]:
        basket, item = _distinct_items(basket, item)
        if not len(item):
            return
        starts = np.flatnonzero(np.r_[True, basket[1:] != basket[:-1]])
        sizes = np.diff(np.r_[starts, len(item)])
        runs.n_baskets += len(starts)
        for counted in runs.add(item << 32 | item):
            yield _run_batch(*counted)
        for k in np.flatnonzero(sizes > wide):
            yield from _two_blocks(item[starts[k] : starts[k] + sizes[k]], block)
        narrow = np.repeat(sizes <= wide, sizes)
        for codes in _codes(basket[narrow], item[narrow], sizes[sizes <= wide]):
            for counted in runs.add(codes):
                yield _run_batch(*counted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, items, runs = None, np.empty(0, np.int32), _Runs(run)
        for batch in batches:
            if not batch.num_rows:
                continue
            name = batch.column(0)
            new = np.r_[name[0].as_py() != carried, pc.not_equal(name[1:], name[:-1]).to_numpy(zero_copy_only=False)]
            number = np.cumsum(new)
            basket, item = np.r_[np.zeros(len(items), np.int64), number, number], np.concatenate([items, *(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))])
            ended = basket < number[-1]
            if ended.any():
                yield from complete(basket[ended], item[ended], runs)
            carried, items = name[-1].as_py(), np.unique(item[~ended])
        if carried is not None:
            yield from complete(np.zeros(len(items), np.int64), items, runs)
        for counted in runs.end():
            yield _run_batch(*counted)

    return read


def _block_runs(run: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of two blocks to sorted runs."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(run)
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                a, b = (np.asarray(x.values, np.int64) for x in (left, right))
                codes = a[:, None] << 32 | b[None, :]
                for counted in runs.add(codes[np.triu_indices(len(a), 1)] if a[0] == b[0] else codes.ravel()):
                    yield _counts(*counted)
        for counted in runs.end():
            yield _counts(*counted)

    return read


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by code to one row for each code."""
    last, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, n = _run_lengths(*(batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)))
        if last is not None and codes[0] == last:
            n[0] += total
        elif last is not None:
            yield _counts(np.array([last]), np.array([total]))
        last, total = int(codes[-1]), int(n[-1])
        if len(codes) > 1:
            yield _counts(codes[:-1], n[:-1])
    if last is not None:
        yield _counts(np.array([last]), np.array([total]))


def code_counts(rows: DataFrame, wide: int = WIDE, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """``code``, ``n`` over all baskets of ``rows`` (``basket`` string, ``item1``, ``item2`` int, -1 for none)."""
    spark = rows.sparkSession
    merged = rows.where("basket IS NOT NULL").select("basket", "item1", "item2").mapInArrow(_merge_hot, _ROWS)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_basket = merged.repartition(parts, "basket").withColumn("_h", F.xxhash64("basket")).sortWithinPartitions("_h", "basket").drop("_h")
    runs = durable(by_basket.mapInArrow(_sorted_runs(wide, block, run), _RUNS))
    blocks = runs.where("code IS NULL").select("left", "right").repartition(parts).mapInArrow(_block_runs(run), _COUNTS)
    return runs.where("code IS NOT NULL").select("code", "n").unionByName(blocks).repartition("code").sortWithinPartitions("code").mapInArrow(_merge_runs, _COUNTS)


def number_items(items: DataFrame) -> DataFrame:
    """``key``, ``name``, ``item``: 32-bit numbers without gaps."""
    numbered = number_rows(items.select("key", "name"), "key", name="item")
    tall = F.raise_error(F.lit("more items than a packed code can hold")).cast("int")
    return numbered.withColumn("item", F.when(F.col("item") >= 2**31, tall).otherwise(F.col("item").cast("int")))


def pair_statistics(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Every pair of ``items`` (``key``, ``name``) that shares a basket of ``rows`` (``basket``, ``key1``, ``key2``).

    ``name1`` < ``name2``, baskets ``n_ab``, ``n_a``, ``n_b``, ``n_all``; ``lift`` = n_ab n_all / (n_a n_b); ``log_odds``, the logarithm of the odds ratio of the two-by-two
    table with one half added to each cell.
    """
    numbered = number_items(items)
    coded = rows.where("basket IS NOT NULL AND (key1 IS NOT NULL OR key2 IS NOT NULL)")
    for k in ("1", "2"):
        coded = join_dictionary(coded, numbered.select(F.col("key").alias(f"key{k}"), F.col("item").alias(f"item{k}")), f"key{k}", "left")
    coded = coded.where("item1 IS NOT NULL OR item2 IS NOT NULL").select("basket", F.coalesce("item1", F.lit(-1)).alias("item1"), F.coalesce("item2", F.lit(-1)).alias("item2"))
    counts = durable(code_counts(coded)).withColumns({"a": F.shiftright("code", 32).cast("int"), "b": F.col("code").bitwiseAND(F.lit(2**32 - 1)).cast("int")})
    single = counts.where("code >= 0 AND a = b").join(numbered, F.col("a") == F.col("item")).select("item", "name", "n")
    total = counts.where(F.col("code") == BASKET).select(F.col("n").alias("n_all"))
    side = lambda k: single.select(F.col("item").alias(k), F.col("name").alias(f"name_{k}"), F.col("n").alias(f"n_{k}"))
    pairs = counts.where("code >= 0 AND a < b").select("a", "b", F.col("n").alias("n_ab")).join(side("a"), "a").join(side("b"), "b").join(F.broadcast(total))
    swap = F.col("name_a") < F.col("name_b")
    pick = lambda x, y, name: F.when(swap, F.col(x)).otherwise(F.col(y)).alias(name)
    pairs = pairs.select(pick("name_a", "name_b", "name1"), pick("name_b", "name_a", "name2"), "n_ab", pick("n_a", "n_b", "n_a"), pick("n_b", "n_a", "n_b"), "n_all")
    x = {c: F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n_all")}
    odds = F.log((x["n_ab"] + 0.5) * (x["n_all"] - x["n_a"] - x["n_b"] + x["n_ab"] + 0.5) / ((x["n_a"] - x["n_ab"] + 0.5) * (x["n_b"] - x["n_ab"] + 0.5)))
    return pairs.withColumns({"lift": x["n_ab"] * x["n_all"] / (x["n_a"] * x["n_b"]), "log_odds": odds})
