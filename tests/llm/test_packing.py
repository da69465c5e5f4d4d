"""Containers hold what they must, nothing is lost or split without need, and little space is unused."""

from __future__ import annotations

import random

import pytest

from bintangle.llm.packing import container_loads, pack

SCHEMA = "id long, n int, part string"


def check(rows, packed, capacity):
    total, parts = {}, {}
    for r in packed:
        total[r.id] = total.get(r.id, 0) + r.part_size
        parts.setdefault(r.id, []).append(r)
    for id_, n, _ in rows:
        assert total[id_] == max(0, n or 0)
        own = parts[id_]
        assert len(own) == max(1, -(-max(0, n or 0) // capacity))  # split only if it does not fit
        assert sorted(x.part for x in own) == list(range(len(own)))
        assert all((x.container is None) == (x.part_size == 0) for x in own)


@pytest.mark.parametrize(("capacity", "share"), [(100, 50), (64, 1000), (1000, 7)])
def test_whole_and_within_capacity(spark, capacity, share):
    rng = random.Random(capacity)
    sizes = [None, 0, -3, 1, capacity, capacity + 1, 3 * capacity, 3 * capacity - 1] + [min(5 * capacity, max(1, int(rng.lognormvariate(2.5, 1)))) for _ in range(600)]
    rows = [(k, n, "clash") for k, n in enumerate(sizes)]
    packed = pack(spark.createDataFrame(rows, SCHEMA), "n", capacity, share).cache()
    check(rows, packed.collect(), capacity)
    loads = container_loads(packed, capacity).collect()
    assert all(0 < r.load <= capacity and r.unused == capacity - r.load for r in loads)
    used = sum(r.load for r in loads) / (capacity * len(loads))
    assert used > 0.85


def test_little_space_is_unused(spark):
    rng = random.Random(5)
    rows = [(k, rng.randint(1, 900), "") for k in range(4000)]
    loads = container_loads(pack(spark.createDataFrame(rows, SCHEMA), "n", 1000, 500), 1000).collect()
    assert sum(r.load for r in loads) / (1000 * len(loads)) > 0.9


def test_ties_repeats_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 30, "x")] * 10 + [(1, 50, "x")] * 4, SCHEMA)
    packed = pack(df, "n", 100)
    assert packed.count() == 14 and {r.load for r in container_loads(packed, 100).collect()} <= {30, 60, 80, 90, 100, 50}
    assert pack(df.limit(0), "n", 100).count() == 0
