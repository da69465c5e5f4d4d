"""Pair counts against counting in Python, with hot baskets and edge cases."""

from __future__ import annotations

import math
import random
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from bintangle.llm import cooccurrence
from bintangle.llm.cooccurrence import pair_statistics

ROWS, ITEMS = "basket string, key1 string, key2 string", "key string, name string"


def brute(rows, items):
    baskets = {}
    for b, *keys in rows:
        if b is not None:
            baskets.setdefault(b, set()).update(items[k] for k in keys if k in items)
    baskets = [s for s in baskets.values() if s]
    single, both = Counter(x for s in baskets for x in s), Counter(p for s in baskets for p in combinations(sorted(s), 2))
    return {p: (n, single[p[0]], single[p[1]], len(baskets)) for p, n in both.items()}


@pytest.mark.parametrize("held", [2_000_000, 3])
def test_same_as_counting(spark, monkeypatch, held):
    monkeypatch.setattr(cooccurrence, "HELD", held)
    rng = random.Random(2)
    items = {f"k{x}": f"N{x}" for x in range(40)}
    keys = [*items, "unknown", None]
    rows = [(f"r{rng.randint(0, 700)}", rng.choice(keys), rng.choice(keys)) for _ in range(1500)] + [(None, "k1", "k2")] * 50
    rows += [("hot", rng.choice(keys), rng.choice(keys)) for _ in range(1000)] + rows[:100]
    rng.shuffle(rows)
    got = pair_statistics(spark.createDataFrame(rows, ROWS).repartition(3), spark.createDataFrame(list(items.items()), ITEMS)).collect()
    expected = brute(rows, items)
    assert {(r.name1, r.name2): (r.n_ab, r.n_a, r.n_b, r.n_all) for r in got} == expected
    for r in got:
        a, b, c, d = r.n_ab, r.n_a - r.n_ab, r.n_b - r.n_ab, r.n_all - r.n_a - r.n_b + r.n_ab
        assert r.lift == pytest.approx(r.n_ab * r.n_all / (r.n_a * r.n_b))
        assert r.log_odds == pytest.approx(math.log((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))))


def test_a_basket_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        items = {f"k{x}": f"N{x:02d}" for x in range(30)}
        rows = [("a", f"k{x}", f"k{(x * 7) % 30}") for x in range(30)] * 3 + [("b", "k1", "k2"), ("c", "k2", None)]
        got = pair_statistics(spark.createDataFrame(rows, ROWS), spark.createDataFrame(list(items.items()), ITEMS)).collect()
        assert {(r.name1, r.name2): (r.n_ab, r.n_a, r.n_b, r.n_all) for r in got} == brute(rows, items)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")


def test_wide_baskets_are_counted_in_blocks(spark):
    rng = random.Random(4)
    items = {f"k{x}": f"N{x:03d}" for x in range(300)}
    rows = [("wide", f"k{x}", None) for x in range(250)] + [("other", f"k{x}", f"k{299 - x}") for x in range(100)]
    rows += [(f"r{rng.randint(0, 60)}", f"k{rng.randint(0, 299)}", f"k{rng.randint(0, 299)}") for _ in range(400)]
    numbers = {k: n for n, k in enumerate(sorted(items))}
    coded = spark.createDataFrame([(b, *(numbers[k] if k else -1 for k in keys)) for b, *keys in rows], "basket string, item1 int, item2 int").repartition(3)
    name = {n: items[k] for k, n in numbers.items()}
    expected, total = brute(rows, items), len({b for b, *_ in rows})
    for wide, block, run in ((40, 16, 1000), (4096, 1024, 50)):
        got = {r.code: r.n for r in cooccurrence.code_counts(coded, wide, block, run).collect()}
        assert got.pop(cooccurrence.BASKET) == total
        pairs = {tuple(sorted((name[c >> 32], name[c & 0xFFFFFFFF]))): n for c, n in got.items() if c >> 32 != c & 0xFFFFFFFF}
        assert pairs == {p: x[0] for p, x in expected.items()}
        assert sum(n for c, n in got.items() if c >> 32 == c & 0xFFFFFFFF) == sum(len({k for b, *keys in rows if b == basket for k in keys if k}) for basket in {b for b, *_ in rows})


def test_a_basket_of_fifty_thousand_items_stays_small():
    item = np.arange(50_000, dtype=np.int32)
    batches = [pa.RecordBatch.from_arrays([pa.array(["b"] * len(x), pa.string()), pa.array(x), pa.array(x)], names=["basket", "item1", "item2"]) for x in np.array_split(item, 5)]
    tracemalloc.start()
    rows = made = 0
    for batch in cooccurrence._sorted_runs(cooccurrence.WIDE, cooccurrence.BLOCK, cooccurrence.RUN)(iter(batches)):
        rows += batch.num_rows
        if made < 20 and batch.column(0).null_count:
            for out in cooccurrence._block_runs(cooccurrence.RUN)(iter([batch.slice(0, 6).select(["left", "right"])])):
                made += out.num_rows
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 50_000 + 1 + 49 * 50 // 2 and made > 5_000_000 and peak < 500e6


def test_empty_tables(spark):
    items = spark.createDataFrame([("a", "A"), ("b", "B")], ITEMS)
    assert pair_statistics(spark.createDataFrame([], ROWS), items).count() == 0
    assert pair_statistics(spark.createDataFrame([("r", "a", "b")], ROWS), items.limit(0)).count() == 0
    assert pair_statistics(spark.createDataFrame([("r", "x", None), (None, "a", "b")], ROWS), items).count() == 0
