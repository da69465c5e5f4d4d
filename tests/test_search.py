"""What the kernels of the pipeline leave out: the same answers as by trying everything, and no row less."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bintangle.operators import graph, order
from tests.test_broadcasts import moved  # noqa: F401


def some_group(rng, m):
    sizes = rng.integers(1, 5, m)
    scaffold = np.repeat(np.arange(m), sizes)
    inner = np.concatenate([np.arange(k) for k in sizes])
    i, j = np.triu_indices(len(scaffold), 1)
    some = rng.random(len(i)) < 0.6
    return order._Group(sizes, scaffold, inner, i[some], j[some], rng.random(some.sum()))


@pytest.mark.parametrize("seed", range(6))
def test_places_of_a_new_scaffold_are_those_of_all_trials(seed):
    rng = np.random.default_rng(seed)
    group = some_group(rng, 6)
    now, sign = [int(x) for x in rng.permutation(6)[:4]], {k: int(rng.integers(2)) for k in range(6)}
    (new,) = [k for k in range(6) if k not in now][:1]
    best, start = None, sign[new]
    for at in range(5):
        for turn in (start, 1 - start):
            score = group.best([tuple([*now[:at], new, *now[at:]])], [{**sign, new: turn}])[0]
            if best is None or score > best[0]:
                best = score, [*now[:at], new, *now[at:]], turn
        start = 1 - start
    got = group.insert(now, sign, new)
    assert got[1:] == best[1:] and got[0] == pytest.approx(best[0], abs=1e-11)


@pytest.mark.parametrize("both_ways", [False, True])
@pytest.mark.parametrize("seed", range(4))
def test_windows_are_those_of_all_trials(seed, both_ways):
    rng = np.random.default_rng(seed)
    group = some_group(rng, 6)
    now, sign = [int(x) for x in rng.permutation(6)], {k: int(rng.integers(2)) for k in range(6)}
    for at in range(4):
        inside = now[at : at + 3]
        trials = [tuple([*now[:at], *(inside[k] for k in p), *now[at + 3 :]]) for p in order.orders(3, both_ways)]
        score, found, signs = group.best(trials, [{**sign, **dict(zip(inside, s, strict=True))} for s in order.orientations(3)])
        got = group.window(now, sign, at, 3, both_ways)
        assert got[1:] == (list(found), signs) and got[0] == pytest.approx(score, abs=1e-11)


def test_without_contacts_nothing_moves():
    none = np.array([], np.int64)
    group = order._Group(np.array([2, 1, 1]), np.array([0, 0, 1, 2]), np.array([0, 1, 0, 0]), none, none, none.astype(float))
    assert group.insert([0, 1], {}, 2) == (0.0, [2, 0, 1], 0)
    assert group.window([0, 1, 2], {}, 0, 2, False) == (0.0, [0, 1, 2], {})


def planted(spark):
    places = spark.range(60).select(F.lit(1).alias("map_id"), F.col("id").alias("bin_id"), F.col("id").alias("pos"))
    edges = spark.range(3600).select(F.lit(1).alias("map_id"), F.expr("id div 60").alias("i"), (F.col("id") % 60).alias("j")).where("i <= j AND pmod(hash(i, j), 3) = 0")
    return places, edges.withColumn("v", F.when(F.expr("i div 20 = j div 20"), 2.0).otherwise(0.7))


def test_contacts_are_not_sent_for_each_restart(spark, moved):  # noqa: F811
    places, edges = planted(spark)
    n = edges.count()
    assert moved(lambda: graph.communities(places, edges).collect()) < 6 * n  # 20 copies before, and as many for the modularity


def test_the_best_restart_is_the_one_of_the_best_modularity(spark):
    places, edges = planted(spark)
    rows = edges.toPandas()
    tried = [graph.louvain(60, rows.i.to_numpy(), rows.j.to_numpy(), rows.v.to_numpy(), k) for k in range(7)]
    parts = spark.createDataFrame([(1, k, b, int(c)) for k, member in enumerate(tried) for b, c in enumerate(member)], "map_id int, restart int, bin_id long, community long")
    q = {r["restart"]: r["modularity"] for r in graph.modularity(parts, edges, ["map_id", "restart"]).collect()}
    assert [graph.partition_modularity(m, rows.i.to_numpy(), rows.j.to_numpy(), rows.v.to_numpy()) for m in tried] == pytest.approx([q[k] for k in range(7)], abs=1e-12)
    best = max(range(7), key=lambda k: (round(q[k], 12), -k))
    got = graph.communities(places, edges, 7).orderBy("bin_id").toPandas()
    assert got.community.tolist() == tried[best].tolist()


def test_bins_of_a_map_without_contacts_are_communities_of_their_own(spark):
    places, edges = planted(spark)
    lone = spark.createDataFrame([(2, 100, 0), (2, 101, 1)], "map_id int, bin_id long, pos long")
    got = graph.communities(places.unionByName(lone), edges, 2).where("map_id = 2").toPandas()
    assert sorted(got.bin_id) == [100, 101] and got.community.nunique() == 2
