"""Grid density clustering against brute force on planted groups, and its defined edge cases."""

from __future__ import annotations

import math

import numpy as np

from bintangle.llm import clusters

BINS, CONTACTS = "bin_id long, map_id int, v string", "b1 long, b2 long, v double, loaded_at int, map_id int"


def planted(seed, groups=(12, 9, 20), stray=40, chain=3):
    rng = np.random.default_rng(seed)
    n, rows, label, start = sum(groups) + 10, [], {}, 1
    for size in groups:
        for a in range(size):
            label[start + a] = start
            rows += [(start + a, start + b, float(rng.lognormal(2.5, 0.4))) for b in range(a + 1, size) if b - a <= max(chain * 2, size // 2)]
        start += size
    for _ in range(stray):
        a, b = rng.integers(1, n + 1, 2)
        if a != b and label.get(int(a)) != label.get(int(b)):
            rows.append((int(a), int(b), float(30 if rng.random() < 0.2 and {int(a), int(b)} <= label.keys() else rng.lognormal(0, 0.5))))
    return n, rows, label


def brute(rows, least_level=clusters.LEAST_LEVEL, least=clusters.LEAST_DENSITY, members=clusters.LEAST_MEMBERS):
    cell = {(min(a, b), max(a, b)): v for a, b, v in rows}
    mean = np.mean([math.log(v) for v in cell.values()])
    dense, label = set(), {}
    for level in (least_level, least_level + 1):
        own = {k for k, v in cell.items() if math.floor((math.log(v) - mean) / math.log(2)) >= level}
        near = {}
        for a, b in own:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        dense |= {(a, b) for a, b in own if (common := near[a] & near[b]) and len(common) / len((near[a] | near[b]) - {a, b}) >= least}
    label = {x: x for d in dense for x in d}
    for _ in range(len(label)):
        for a, b in dense:
            label[a] = label[b] = min(label[a], label[b])
    found = {}
    for x in label:
        found.setdefault(label[x], set()).add(x)
    return {frozenset(s) for s in found.values() if len(s) >= members}


def frames(spark, n, rows):
    bins = spark.createDataFrame([(k, 1, "x") for k in range(1, n + 1)], BINS)
    return bins, spark.createDataFrame([(a, b, v, 1, 1) for a, b, v in rows], CONTACTS)


def sets(members):
    out = {}
    for r in members.collect():
        out.setdefault(r.cluster, set()).add(r.bin_id)
    return {frozenset(s) for s in out.values()}


def test_same_as_brute_force_and_as_planted(spark):
    for seed in range(3):
        n, rows, label = planted(seed)
        latest = {(min(a, b), max(a, b)): v for a, b, v in rows}
        rows = [(a, b, v) for (a, b), v in latest.items()]
        members = clusters.cluster_members(*frames(spark, n, rows))
        assert sets(members) == brute(rows)
        assert sets(members) == {frozenset(x for x, g in label.items() if g == start) for start in set(label.values())}
    pairs = {tuple(r) for r in clusters.member_pairs(members).collect()}
    assert len(pairs) == sum(s * (s - 1) // 2 for s in (12, 9, 20)) and all(a < b for a, b in pairs)
    described = clusters.describe_clusters(members).collect()
    assert sorted(r.n_bins for r in described) == [9, 12, 20] and all(len(r.typical) == 3 for r in described)


def test_a_bin_with_strong_contacts_to_a_few_of_each_group_joins_none(spark):
    n, rows, label = planted(1, stray=0)
    rows += [(n, x, 30.0) for x in (1, 2, 13, 14, 22, 23)]
    found = sets(clusters.cluster_members(*frames(spark, n, rows)))
    assert found == {frozenset(x for x, g in label.items() if g == start) for start in set(label.values())}


def test_defined_cases(spark):
    clique = [(a, b, 5.0, 1, 1) for a in range(1, 6) for b in range(a + 1, 6)]
    odd = [(1, 1, 9.0, 1, 1), (1, 99, 9.0, 1, 1), (None, 2, 9.0, 1, 1), (2, 6, None, 1, 1), (3, 6, float("nan"), 1, 1), (4, 6, 0.0, 1, 1), (5, 6, -1.0, 1, 1), (1, 6, float("inf"), 1, 1), (2, 1, 5.0, 1, 1), (7, 1, 50.0, 1, 1), (7, 1, 0.0, 2, 1), (8, 1, 9.0, 1, 1)]
    bins = spark.createDataFrame([(k, 1, "x") for k in range(1, 8)] + [(1, 1, "again"), (8, 2, "other map"), (None, 1, "x")], BINS)
    members = clusters.cluster_members(bins, spark.createDataFrame(clique + clique + odd, CONTACTS))
    assert sets(members) == {frozenset(range(1, 6))}
    none = clusters.cluster_members(bins.limit(0), spark.createDataFrame([], CONTACTS))
    assert none.count() == 0 and clusters.member_pairs(none).count() == 0 and clusters.describe_clusters(none).count() == 0


def test_labels_reach_along_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101)], "i long, j long")
    labels = {r.node: r.label for r in clusters.propagate_labels(edges).collect()}
    assert all(labels[k] == 1 for k in range(1, 61)) and labels[101] == 100


def test_a_map_of_many_blocks_and_both_ways_of_counting(spark):
    rng = np.random.default_rng(5)
    n, size = 5200, 40
    near = [(a, b) for start in range(1, n + 1, size) for a in range(start, start + size) for b in range(a + 1, start + size) if b - a <= 12]
    stray = [(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(1, n + 1, (4000, 2)) if a // size != b // size]
    order = rng.permutation(n) + 1  # groups lie over all blocks
    cell = {tuple(sorted((int(order[a - 1]), int(order[b - 1])))): int(rng.integers(-1, 3)) for a, b in [*near, *stray]}
    cells = spark.createDataFrame([(1, i, j, level) for (i, j), level in cell.items()], "map_id int, i long, j long, level int").repartition(4)
    rounded = lambda df: {(r.map_id, r.i, r.j): round(r.density, 12) for r in df.collect()}
    blocks = rounded(clusters.dense_cells(cells))
    assert blocks == rounded(clusters.dense_cells(cells, most_blocks=0))
    for least in (-1, 0):
        beside = {}
        for (i, j), level in cell.items():
            if level >= least:
                beside.setdefault(i, set()).add(j)
                beside.setdefault(j, set()).add(i)
        share = {(1, i, j): len(beside[i] & beside[j]) / max(1, len((beside[i] | beside[j]) - {i, j})) for (i, j), level in cell.items() if level >= least}
        assert all(blocks.get(k, 0) >= x - 1e-9 for k, x in share.items() if x >= clusters.LEAST_DENSITY)


def test_labels_of_a_hub_a_long_chain_and_no_edges(spark):
    edges = [(1000, k) for k in range(1001, 1400)] + [(k, k + 1) for k in range(1, 300)] + [(300, 5), (7, 7)]
    labels = {r.node: r.label for r in clusters.propagate_labels(spark.createDataFrame(edges, "i long, j long")).collect()}
    assert {labels[k] for k in range(1, 301)} == {1} and {labels[k] for k in range(1000, 1400)} == {1000}
    assert clusters.propagate_labels(spark.createDataFrame([], "i long, j long")).count() == 0
