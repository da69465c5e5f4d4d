"""Percentiles of very large numeric columns by deterministic buffer collapsing.

A sketch is a set of sorted buffers. Values fill a buffer of ``size`` with weight 1; two full buffers of equal weight collapse into one of double weight that
keeps every second of their merged values, first the odd and then the even places. A collapse of two buffers of weight w moves the rank of
any value by at most w; the sum of these is carried with the sketch as ``err``, so each sketch states its own bound. Counts are exact.

A sketch is stored as rows (keys, ``weight``, ``buffer``, ``err``). Sketches of partitions or days combine by uniting their rows and merging by key, in
two rounds (by key and bucket, then by key), so the work for one key is spread and the collapses form a tree.

Defined cases: null and NaN values are left out, infinite ones take part; null keys form a group of their own; ties and repeated rows count as often as they occur; a key
without values has no row; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values in a buffer: with n values the rank error is at most n log2(n / size) / (2 size).
SIZE = 2048
#: Values a task holds over all keys before it hands its sketches on.
HELD = 4_000_000
#: Sketches or answers in one outgoing batch.
OUT = 500
#: Share of the first merging round.
BUCKETS = 16
STORED = "weight bigint, buffer array<double>, err bigint"


class Sketch:
    """Sorted buffers by weight, and raw values that do not fill a buffer yet."""

    def __init__(self, size: int) -> None:
        self.size, self.err, self.raw, self.n_raw = size, 0, [], 0
        self.waiting: dict[int, np.ndarray] = {}
        self.odd: dict[int, int] = defaultdict(int)

    def add(self, values: np.ndarray) -> None:
        self.raw.append(values)
        self.n_raw += len(values)
        if self.n_raw >= self.size:
            values = np.concatenate(self.raw)
            full = len(values) // self.size * self.size
            for k in range(0, full, self.size):
                self.add_buffer(1, np.sort(values[k : k + self.size]))
            self.raw, self.n_raw = [values[full:]], len(values) - full

    def add_buffer(self, weight: int, buffer: np.ndarray) -> None:
        while weight in self.waiting:
            both = np.sort(np.concatenate([self.waiting.pop(weight), buffer]), kind="stable")
            buffer = both[self.odd[weight] :: 2]
            self.odd[weight] ^= 1
            self.err += weight
            weight *= 2
        self.waiting[weight] = buffer

    def add_stored(self, weight: int, buffer: np.ndarray, err: int) -> None:
        self.err += err
        if len(buffer) == self.size:
            self.add_buffer(weight, buffer)
        else:
            self.add(buffer)

    def rows(self) -> list[tuple[int, np.ndarray, int]]:
        found = sorted(self.waiting.items())
        if self.n_raw:
            found.append((1, np.sort(np.concatenate(self.raw))))
        return [(w, b, self.err if k == 0 else 0) for k, (w, b) in enumerate(found)]


def _stored(sketches: dict[tuple, Sketch], schema: pa.Schema) -> pa.RecordBatch:
    rows = [(*key, *row) for key, sketch in sketches.items() for row in sketch.rows()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _key_codes(batch: pa.RecordBatch, keys: int) -> tuple[np.ndarray, list[tuple]]:
    """A number for each row's key, and the keys by number; nulls are a key."""
    code, sizes, values = np.zeros(batch.num_rows, np.int64), [], []
    for k in range(keys):
        coded = batch.column(k).dictionary_encode(null_encoding="encode")
        values.append(coded.dictionary.to_pylist())
        code = code * len(values[-1]) + coded.indices.to_numpy(zero_copy_only=False)
        sizes.append(len(values[-1]))
    present, code = np.unique(code, return_inverse=True)
    names = []
    for p in present.tolist():
        name = []
        for size, column in zip(reversed(sizes), reversed(values), strict=True):
            p, r = divmod(p, size)
            name.append(column[r])
        names.append(tuple(reversed(name)))
    return code, names


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def _key_ddl(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def build_sketches(df: DataFrame, keys: list[str], value: str, size: int = SIZE) -> DataFrame:
    """``keys``, ``weight``, ``buffer``, ``err``: one sketch for each key and task, made where the rows lie; merge them with :func:`merge_sketches`."""
    ddl, n_keys = f"{_key_ddl(df, keys)}, {STORED}", len(keys)
    schema = _arrow_schema(ddl)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches: dict[tuple, Sketch] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            code, names = _key_codes(batch, n_keys)
            values = batch.column(n_keys).to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            for name, own in zip(names, np.split(values[order], np.cumsum(np.bincount(code))[:-1]), strict=True):
                if name not in sketches:
                    sketches[name] = Sketch(size)
                sketches[name].add(own)
            if len(sketches) * size > HELD:
                yield _stored(sketches, schema)
                sketches = {}
        if sketches:
            yield _stored(sketches, schema)

    number = F.col(value).cast("double")
    return df.where(number.isNotNull() & ~F.isnan(number)).select(*keys, number.alias("_value")).mapInArrow(build, ddl)


def _stored_rows(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, int, np.ndarray, int]]:
    """Key, weight, buffer and err of each stored row."""
    for batch in batches:
        names = list(zip(*(batch.column(k).to_pylist() for k in range(keys)), strict=True))
        buffer = batch.column(keys + 1)
        values, ends = buffer.values.to_numpy(zero_copy_only=False), buffer.offsets.to_numpy()
        weights, errs = batch.column(keys).to_pylist(), batch.column(keys + 2).to_pylist()
        for r, name in enumerate(names):
            yield name, weights[r], values[ends[r] : ends[r + 1]], errs[r]


def _merged(sketches: DataFrame, by: list[str], size: int) -> DataFrame:
    """Sketches of equal keys become one, in a stream over rows sorted by key and content, so the order in which they arrive changes nothing."""
    ddl, n_keys = f"{_key_ddl(sketches, by)}, {STORED}", len(by)
    schema = _arrow_schema(ddl)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[tuple, Sketch] = {}
        at = None
        for name, weight, buffer, err in _stored_rows(batches, n_keys):
            if name != at:
                if len(done) >= OUT:
                    yield _stored(done, schema)
                    done = {}
                at = name
                done[name] = Sketch(size)
            done[name].add_stored(weight, buffer, err)
        if done:
            yield _stored(done, schema)

    return sketches.select(*by, "weight", "buffer", "err").repartition(*by).sortWithinPartitions(*by, "weight", "err", "buffer").mapInArrow(merge, ddl)


def merge_sketches(sketches: DataFrame, keys: list[str], size: int = SIZE, buckets: int = BUCKETS) -> DataFrame:
    """One sketch for each key; ``sketches`` may unite any partitions or days made with the same ``size``. Columns beyond ``keys`` are merged over."""
    salted = sketches.select(*keys, F.pmod(F.xxhash64("buffer"), F.lit(buckets)).cast("int").alias("_bucket"), "weight", "buffer", "err")
    return _merged(_merged(salted, [*keys, "_bucket"], size), keys, size)


def percentiles(sketches: DataFrame, keys: list[str], at: list[float]) -> DataFrame:
    """``keys``, ``q``, ``value``, ``n``, ``rank_error`` from one sketch for each key: the true rank of ``value`` is within ``rank_error`` rows of ``q`` n."""
    ddl, n_keys = f"{_key_ddl(sketches, keys)}, q double, value double, n bigint, rank_error bigint", len(keys)
    schema = _arrow_schema(ddl)

    def answer(name: tuple, rows: list[tuple[int, np.ndarray, int]]) -> list[tuple]:
        values = np.concatenate([b for _, b, _ in rows])
        order = np.argsort(values, kind="stable")
        reached = np.cumsum(np.repeat([w for w, _, _ in rows], [len(b) for _, b, _ in rows])[order])
        n, err = int(reached[-1]), sum(e for _, _, e in rows)
        places = np.minimum(np.searchsorted(reached, [max(q * n, 1) for q in at]), len(values) - 1)
        return [(*name, q, float(values[order[p]]), n, err) for q, p in zip(at, places, strict=True)]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, out = None, [], []
        for name, *row in _stored_rows(batches, n_keys):
            if name != last and held:
                out += answer(last, held)
                held = []
                if len(out) >= OUT:
                    yield batch(out)
                    out = []
            last = name
            held.append(tuple(row))
        if held:
            out += answer(last, held)
        if out:
            yield batch(out)

    return sketches.select(*keys, "weight", "buffer", "err").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(read, ddl)
