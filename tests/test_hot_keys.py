"""Accumulator arrays against plain counting, and the defined edge cases."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from bintangle.operators import hot_keys
from bintangle.operators.hot_keys import heavy_keys, per_key
from bintangle.session import join_dictionary

NAMES, ROWS = "key string, name string", "key string, value bigint"


def test_same_as_counting(spark, monkeypatch):
    rng = np.random.default_rng(0)
    keys = [f"k{x:04d}" for x in range(9000)]
    rows = [(keys[0] if rng.random() < 0.5 else keys[int(rng.integers(9000))], None if rng.random() < 0.1 else int(rng.integers(-50, 50))) for _ in range(20_000)] + [(None, 1), ("unknown", 2)]
    got = {r.name: r for r in per_key(spark.createDataFrame(rows, ROWS).repartition(7), spark.createDataFrame([(k, k.upper()) for k in keys], NAMES)).collect()}
    expected = defaultdict(list)
    for k, v in rows:
        expected[k].append(v)
    assert len(got) == 9000  # more keys than one block holds
    for k in keys:
        known = [v for v in expected[k] if v is not None]
        r = got[k.upper()]
        assert (r.n, r.n_value, r.total) == (len(expected[k]), len(known), sum(known))
        assert (r.low, r.high) == ((min(known), max(known)) if known else (None, None))


def test_blocks_handed_on_early(spark):
    rows = spark.createDataFrame([(f"k{x}", x) for x in range(10_000)], ROWS).coalesce(1)
    names = spark.createDataFrame([(f"k{x}", f"k{x}") for x in range(10_000)], NAMES)
    total = per_key(rows, names).groupBy().sum("n", "total").first()
    assert tuple(total) == (10_000, sum(range(10_000)))
    assert hot_keys.BLOCK < 10_000


def test_sums_are_exact(spark):
    big, least, most = 2**53 + 1, -(2**63), 2**63 - 1
    rows = spark.createDataFrame([("a", big)] * 3 + [("b", most)] * 5 + [("c", least)] * 4 + [("c", 1), ("d", -1), ("d", -(2**26))], ROWS).repartition(3)
    got = {r.name: (int(r.total), r.low, r.high) for r in per_key(rows, spark.createDataFrame([(k, k) for k in "abcd"], NAMES)).collect()}
    assert got == {"a": (3 * big, big, big), "b": (5 * most, most, most), "c": (4 * least + 1, least, 1), "d": (-1 - 2**26, -(2**26), -1)}


def test_key_numbers_have_no_gaps(spark):
    names = spark.range(0, 20_000).selectExpr("cast(id AS string) AS key", "cast(id AS string) AS name").repartition(9)
    assert {r.key_id for r in hot_keys.encode_keys(names).collect()} == set(range(20_000))


def test_heavy_keys_count_all_rows(spark):
    rows = spark.createDataFrame([("a", 1)] * 30 + [("b", None)] * 19 + [(None, 1)] * 51, ROWS)
    names = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], NAMES)
    assert [r.name for r in heavy_keys(rows, names, 0.2).collect()] == ["A"]
    assert {r.name for r in heavy_keys(rows, names, 0.19).collect()} == {"A", "B"}


def test_empty_tables(spark):
    none, names = spark.createDataFrame([], ROWS), spark.createDataFrame([("a", "A")], NAMES)
    assert heavy_keys(none, names, 0.02).count() == 0
    assert [(r.name, r.n, r.low) for r in per_key(none, names).collect()] == [("A", 0, None)]
    assert per_key(spark.createDataFrame([("a", 1)], ROWS), spark.createDataFrame([], NAMES)).count() == 0


def test_salted_join_gives_the_same_rows(spark):
    rows = spark.createDataFrame([("a", k) for k in range(50)] + [("b", 1), (None, 2), ("z", 3)], ROWS)
    names = spark.createDataFrame([("a", "A"), ("b", "B")], NAMES)
    for how in ("inner", "left", "left_semi"):
        both = [sorted(map(str, join_dictionary(rows, names, "key", how, n).collect())) for n in (10, 1)]
        assert both[0] == both[1]
