"""The rank of each reported percentile against the sorted values, through merging by day and key."""

from __future__ import annotations

import numpy as np
import pytest

from bintangle.llm.quantiles import Sketch, build_sketches, merge_sketches, percentiles

QS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def within(values, q, value, err):
    values = np.sort(values)
    below, up_to = np.searchsorted(values, value, "left"), np.searchsorted(values, value, "right")
    return below <= q * len(values) + err and up_to >= q * len(values) - err


@pytest.mark.parametrize("shape", ["normal", "sorted", "falling", "ties"])
def test_sketch_keeps_count_and_bound(shape):
    rng = np.random.default_rng(0)
    x = {"normal": rng.normal(size=50_000), "sorted": np.arange(50_000.0), "falling": np.arange(50_000.0)[::-1], "ties": rng.integers(0, 5, 50_000).astype(float)}[shape]
    sketches = []
    for part in np.array_split(x, 7):
        s = Sketch(64)
        for piece in np.array_split(part, 11):
            s.add(piece)
        sketches.append(s)
    one = Sketch(64)
    for s in sketches:
        for row in s.rows():
            one.add_stored(*row)
    rows = one.rows()
    assert sum(w * len(b) for w, b, _ in rows) == 50_000
    err = sum(r[2] for r in rows)
    assert err <= 50_000 * 12 / (2 * 64)
    values = np.concatenate([b for _, b, _ in rows])
    weights = np.concatenate([[w] * len(b) for w, b, _ in rows])
    at = np.argsort(values)
    reached = np.cumsum(weights[at])
    for q in QS:
        assert within(x, q, values[at][min(np.searchsorted(reached, max(q * 50_000, 1)), len(values) - 1)], err)


def test_days_combine_and_bound_holds(spark):
    rng = np.random.default_rng(1)
    rows = [(int(m), int(d), float(rng.lognormal(m, 1))) for m, d in zip(rng.choice(3, 30_000, p=[0.8, 0.15, 0.05]), rng.integers(0, 4, 30_000), strict=True)]
    odd = [(0, 0, None), (0, 1, float("nan")), (None, 2, 7.0), (5, 0, None)]
    df = spark.createDataFrame(rows + odd, "m int, day int, v double").repartition(5)
    days = merge_sketches(build_sketches(df, ["m", "day"], "v", 128), ["m", "day"], 128, 3)
    got = percentiles(merge_sketches(days, ["m"], 128, 3), ["m"], QS).collect()
    assert {r.m for r in got} == {0, 1, 2, None}
    for r in got:
        own = np.array([v for m, _, v in rows if m == r.m] if r.m is not None else [7.0])
        assert r.n == len(own) and within(own, r.q, r.value, r.rank_error)
        assert r.rank_error <= max(1, len(own)) * 0.08
    exact = percentiles(merge_sketches(build_sketches(df.where("m = 2"), ["m"], "v"), ["m"]), ["m"], [0.5]).first()
    assert exact.rank_error == 0


def test_infinite_values_take_part_and_empty_tables_give_none(spark):
    df = spark.createDataFrame([(1, float("-inf")), (1, 0.0), (1, float("inf"))], "k int, v double")
    got = percentiles(merge_sketches(build_sketches(df, ["k"], "v"), ["k"]), ["k"], [0.0, 0.5, 1.0]).collect()
    assert [r.value for r in got] == [float("-inf"), 0.0, float("inf")]
    none = build_sketches(df.limit(0), ["k"], "v")
    assert percentiles(merge_sketches(none, ["k"]), ["k"], [0.5]).count() == 0


def test_the_order_of_stored_rows_changes_nothing(spark):
    rng = np.random.default_rng(8)
    rows = [(int(k), float(v)) for k, v in zip(rng.integers(0, 2, 40_000), rng.normal(size=40_000), strict=True)]
    built = build_sketches(spark.createDataFrame(rows, "k int, v double").repartition(20), ["k"], "v", 32).collect()
    assert max(r.weight for r in built) >= 16
    answers = []
    for turn in range(3):
        drawn = [built[k] for k in np.random.default_rng(turn).permutation(len(built))]
        stored = spark.createDataFrame(drawn, "k int, weight long, buffer array<double>, err long").repartition(turn + 2)
        answers.append(sorted(map(tuple, percentiles(merge_sketches(stored, ["k"], 32), ["k"], QS).collect())))
    assert answers[0] == answers[1] == answers[2]
    for k, q, value, n, err in answers[0]:
        own = [v for key, v in rows if key == k]
        assert n == len(own) and err >= 64 and within(own, q, value, err)
