"""Assembly operators against naive loops, and on planted structure."""

from __future__ import annotations

import math
import random
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from bintangle.functions.special import harmonic, log_factorial, reverse_complement, wrap
from bintangle.operators import cuts, emit, enrichment, graph, matrix, order, orient, vote
from bintangle.plans.config import Config, missing, parse_config
from bintangle.plans.pipeline import find_groups, join_sequences
from bintangle.sources import maps, text


def test_special_functions(spark):
    df = spark.range(0, 400).select("id", log_factorial(F.col("id")).alias("lf"), harmonic(F.col("id")).alias("h"))
    for r in df.collect():
        assert r.lf == pytest.approx(math.lgamma(r.id + 1), abs=1e-9)
        assert r.h == pytest.approx(sum(1 / k for k in range(1, r.id + 1)), abs=1e-13)


def test_reverse_complement_and_wrap(spark):
    df = spark.createDataFrame([("ACGTNacgtn",), ("",), ("A" * 51,)], "s string")
    got = df.select(reverse_complement(F.col("s")), reverse_complement(reverse_complement(F.col("s"))), wrap(F.col("s"))).collect()
    assert got[0][0] == "nacgtNACGT" and [r[1] for r in got] == ["ACGTNacgtn", "", "A" * 51]
    assert [r[2] for r in got] == [["ACGTNacgtn"], [], ["A" * 50, "A"]]
    with pytest.raises(Exception, match="other than ACGTN"):
        spark.createDataFrame([("ACRT",)], "s string").select(reverse_complement(F.col("s"))).collect()


def exact_tail(x, M, n, N):
    return sum(math.comb(n, k) * math.comb(M - n, N - k) for k in range(x, min(n, N) + 1) if N - k <= M - n) / math.comb(M, N)


def test_hypergeometric_tail(spark):
    rng = random.Random(3)
    rows = []
    for k in range(300):
        M = rng.randint(1, 400)
        n, N = rng.randint(0, M), rng.randint(0, M)
        rows.append((k, rng.randint(0, min(n, N) + 1), M, n, N))
    rows.append((300, 3, 5, 6, 2))
    df = spark.createDataFrame(rows, "id int, x int, m int, s int, d int")
    lf = np.r_[0.0, np.cumsum(np.log(np.arange(1, 401)))]
    for r in enrichment.hypergeometric_tail(df, "x", "m", "s", "d").collect():
        kernel = cuts.tail(np.array([r.x]), r.m, np.array([r.s]), np.array([r.d]), lf)[0]
        if r.id == 300:
            assert math.isnan(r.p) and math.isnan(kernel)
        else:
            assert r.p == pytest.approx(exact_tail(r.x, r.m, r.s, r.d), abs=1e-9) and kernel == pytest.approx(r.p, abs=1e-9)


def test_hypergeometric_tail_of_large_populations(spark):
    rows = [(0, 10, 20_000, 9000, 9000), (1, 4050, 20_000, 9000, 9000), (2, 6000, 20_000, 9000, 9000), (3, 9000, 20_000, 9000, 9000), (4, 4200, 20_000, 9000, 9000)]
    lf = np.r_[0.0, np.cumsum(np.log(np.arange(1, 20_001)))]
    for r in enrichment.hypergeometric_tail(spark.createDataFrame(rows, "id int, x int, m int, s int, d int"), "x", "m", "s", "d").collect():
        assert r.p == pytest.approx(cuts.tail(np.array([r.x]), r.m, np.array([r.s]), np.array([r.d]), lf)[0], abs=1e-9)


def random_map(seed, n=30):
    rng = np.random.default_rng(seed)
    m = np.triu(np.where(rng.random((n, n)) < 0.4, rng.integers(1, 6, (n, n)), 0))
    return m + np.triu(m, 1).T


def cells_of(spark, m):
    rows = [(1, int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(rows, "map_id int, i long, j long, v double")


def test_sparse_rank_overlap_is_the_dense_one(spark):
    m = random_map(5)
    n = len(m)
    order_ = cuts.rank_order(m)
    got = {r.i: r.x for r in enrichment.rank_overlap(matrix.ranks(cells_of(spark, m)), spark.createDataFrame([(1, n)], "map_id int, n long")).collect()}
    assert got == {i: sum(0 <= j <= i for j in order_[i, :i]) for i in range(1, n)}


def test_half_window_contrast_examples(spark):
    flags = [1, 1, 10, 0, 1, 0], [1, 1, 1, 0, 1, 0]
    for f, best in zip(flags, (11, 2), strict=True):
        df = spark.createDataFrame([(1, k, v) for k, v in enumerate(f)], "map_id int, i int, flag int")
        assert enrichment.leftmost_best(enrichment.half_window_contrast(df, 3)).first().best == best


def test_first_breakpoint_and_state_switch(spark):
    rng = random.Random(1)
    rows, expected, switched = [], {}, {}
    for m in range(60):
        w, f = 3, [int(rng.random() < 0.6) for _ in range(rng.randint(2, 30))]
        rows += [(m, k, v) for k, v in enumerate(f)]
        expected[m] = next((k for k in range(w, len(f) - w + 1) if all(f[k - w : k]) and not any(f[k : k + w])), None)
        base = int(2 * sum(f[:w]) > len(f[:w]))
        switched[m] = next((k for k in range(len(f) - w) if all(x != base for x in f[k : k + w])), None)
        assert graph.boundary(np.array(f), w) == switched[m]
    df = spark.createDataFrame(rows, "map_id int, i int, flag int")
    assert {r.map_id: r.cut for r in enrichment.first_breakpoint(df, 3).collect()} == expected
    states = df.select("map_id", F.col("i").alias("pos"), F.col("flag").alias("state"))
    assert {r.map_id: r["at"] for r in enrichment.state_switch(states, 3).collect()} == switched


def test_distance_similarity_and_logs(spark):
    m = random_map(2)
    cells = cells_of(spark, m)
    d = {(r.i, r.j): r.d for r in matrix.distances(cells).collect()}
    assert all(v == pytest.approx(2 - m[i, j] / m[i].sum()) for (i, j), v in d.items())
    back = matrix.similarities(matrix.distances(cells), matrix.row_sums(cells)).collect()
    assert all(r.s == pytest.approx(m[r.i, r.j]) for r in back)
    assert all(r.v == pytest.approx(m[r.i, r.j]) for r in matrix.unlog_cells(matrix.log_cells(cells)).collect())


def test_clip_bounds_are_dense_percentiles(spark):
    m = random_map(8)
    got = {r.q: r.bound for r in matrix.clip_bounds(cells_of(spark, m), spark.createDataFrame([(1, len(m))], "map_id int, n long"), 0.3, 0.98).collect()}
    assert got == {0.3: pytest.approx(np.percentile(m, 30)), 0.98: pytest.approx(np.percentile(m, 98))}


def planted(groups=3, scaffolds=4, bins=5, seed=0, weak=0.02):
    """Groups of scaffolds of bins in a hidden order, contacts 1 / (1 + distance) within a group, weak ones between."""
    rng = np.random.default_rng(seed)
    n = groups * scaffolds * bins
    place = np.arange(n)
    g = place // (scaffolds * bins)
    m = np.where(g[:, None] == g[None], 100 / (1 + np.abs(place[:, None] - place[None])), weak * rng.random((n, n)))
    m = (m + m.T) / 2
    shuffled = rng.permutation(groups * scaffolds)
    rows, true = [], []
    for new, s in enumerate(shuffled):
        own = place[s * bins : (s + 1) * bins]
        own = own[::-1] if rng.random() < 0.5 else own
        for k, p in enumerate(own):
            rows.append((1, len(rows) + 1, f"s{new:02d}", k * 10, k * 10 + 10, 1.0, len(rows)))
            true.append(p)
    return rows, m[np.ix_(true, true)], np.array(true)


BINS = "map_id int, bin_id long, scaffold string, start long, stop long, bias double, ord long"


def planted_frames(spark, **kw):
    rows, m, true = planted(**kw)
    up = [(1, i + 1, j + 1, float(m[i, j])) for i in range(len(m)) for j in range(i, len(m))]
    return spark.createDataFrame(rows, BINS), spark.createDataFrame(up, "map_id int, i long, j long, v double"), m, true


def test_pipeline_recovers_planted_groups_and_order(spark):
    bins, cells, m, true = planted_frames(spark)
    sizes = spark.createDataFrame([(f"s{k:02d}", 50 + k) for k in range(12)], "scaffold string, size long")
    for strategy in ("overlap", "modularity only"):
        config = Config(modularity=1.0 if strategy != "overlap" else 0.05, restarts=3, min_size=5)
        groups = find_groups(bins, cells, sizes, config).toPandas()
        got = groups.assign(true=true[groups["bin_id"] - 1] // 20).groupby("group_id")["true"]
        assert len(groups) == 60 and got.nunique().eq(1).all()
    assert groups["group_id"].nunique() == 3  # rank overlap may cut a group again, communities do not
    ordered = order.order_groups(spark.createDataFrame(groups), cells, 4, 3).toPandas()
    by_name = bins.toPandas().assign(true=true).groupby("scaffold")["true"].apply(list)
    for _, own in ordered.sort_values("ord").groupby("group_id"):
        places = [p for s, o in zip(own["scaffold"], own["orientation"], strict=True) for p in (by_name[s][::-1] if o == "-" else by_name[s])]
        steps = np.diff(places)
        assert (steps == 1).all() or (steps == -1).all()


def test_scores_by_pairs_are_those_by_contacts():
    rng = np.random.default_rng(2)
    for m in (2, 4, 6):
        sizes = rng.integers(1, 6, m)
        scaffold, inner = np.repeat(np.arange(m), sizes), np.concatenate([np.arange(k) for k in sizes])
        i, j = np.triu_indices(len(scaffold), 1)
        keep = rng.random(len(i)) < 0.6
        flip = rng.random(keep.sum()) < 0.5
        i, j = np.where(flip, j[keep], i[keep]), np.where(flip, i[keep], j[keep])
        group = order._Group(sizes, scaffold, inner, i, j, rng.random(len(i)))
        orders_, signs = np.array(order.orders(m, True)), np.array(order.orientations(m))
        offset = np.zeros(orders_.shape, np.int64)
        np.put_along_axis(offset, orders_, np.cumsum(sizes[orders_], axis=1) - sizes[orders_], axis=1)
        every = np.ones(len(i), bool)
        assert np.allclose(group._each(offset, signs.astype(bool), every), group._by_pairs(offset, signs, every), atol=1e-12)
        some, few = offset[:1] + np.arange(2)[:, None] * (np.arange(m) == 0), signs * (np.arange(m) == m - 1)  # one moves, one turns, the others stay
        assert np.allclose(group._each(some, few.astype(bool), every), group._by_pairs(some, few, every), atol=1e-12)


def naive_score(m):
    n = len(m)
    traces = [np.trace(m, offset=k) for k in range(1, n)]
    return sum(sum(traces[:k]) / sum(traces) / k for k in range(1, n))


def test_score_is_the_mean_of_running_diagonals_and_survives_reversal(spark):
    _, cells, m, _ = planted_frames(spark, groups=1, scaffolds=3, bins=4)
    rng = np.random.default_rng(4)
    p = rng.permutation(len(m))
    place = np.argsort(p)
    rows = [(1, 1 + g, int(b + 1), int(x if g == 0 else len(m) - 1 - x)) for g in (0,) for b, x in enumerate(place)]
    df = spark.createDataFrame(rows, "map_id int, group_id long, bin_id long, pos long")
    flipped = df.withColumn("pos", len(m) - 1 - F.col("pos"))
    a, b = order.score_orders(cells, df).first(), order.score_orders(cells, flipped).first()
    assert a.score == pytest.approx(naive_score(m[np.ix_(p, p)])) and b.score == pytest.approx(a.score)
    assert a.total == pytest.approx(np.triu(m, 1).sum())


def test_search_is_exhaustive_for_few_scaffolds(spark):
    bins, cells, m, _ = planted_frames(spark, groups=1, scaffolds=3, bins=3, seed=7)
    assigned = bins.select("map_id", F.lit(1).cast("long").alias("group_id"), "scaffold", "bin_id")
    got = order.order_groups(assigned, cells, 3, 3).first().score
    own = [list(range(k * 3, k * 3 + 3)) for k in range(3)]
    best = max(naive_score(m[np.ix_(q, q)]) for p in permutations(range(3)) for s in order.orientations(3) for q in [[b for k in p for b in (own[k][::-1] if s[k] else own[k])]])
    assert got == pytest.approx(best)


def test_candidates():
    assert [len(order.orders(n)) * len(order.orientations(n)) for n in (2, 3, 4, 5)] == [math.factorial(n) * 2**n // 2 for n in (2, 3, 4, 5)]
    assert order.orientations(3)[0] == (0, 0, 0) and len(set(order.orientations(3))) == 8


def test_average_linkage_matches_a_naive_one():
    rng = np.random.default_rng(0)
    d = rng.random((14, 14))
    d = (d + d.T) / 2
    clusters = [[k] for k in range(14)]
    while len(clusters) > 1:
        pairs = [(d[np.ix_(a, b)].mean(), x, y) for x, a in enumerate(clusters) for y, b in enumerate(clusters) if x < y]
        _, x, y = min(pairs)
        p, q = sorted([clusters[x], clusters[y]], key=lambda c: (len(c), min(c)))
        clusters = [c for k, c in enumerate(clusters) if k not in (x, y)] + [p + q]
    assert graph.average_linkage(d) == clusters[0]


def test_modularity_and_communities(spark):
    bins, cells, m, true = planted_frames(spark)
    places = bins.select("map_id", "bin_id", F.col("ord").alias("pos"))
    logs = matrix.log_cells(cells).select("map_id", "i", "j", F.col("lg").alias("v"))
    found = graph.communities(places, logs, 3).toPandas()
    assert found.assign(g=true[found["bin_id"] - 1] // 20).groupby("community")["g"].nunique().eq(1).all() and found["community"].nunique() == 3
    w = np.log10(m + 1)
    label = true // 20
    total, degree = np.triu(w).sum(), w.sum(1) + np.diag(w)
    expected = sum(np.triu(w)[np.ix_(label == c, label == c)].sum() / total - (degree[label == c].sum() / (2 * total)) ** 2 for c in range(3))
    assert graph.modularity(spark.createDataFrame(found), logs, ["map_id"]).first().modularity == pytest.approx(expected)


def test_two_states_find_the_switch():
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(2, 0.3, (40, 5)), rng.normal(0, 0.3, (50, 5))]
    assert abs(graph.boundary(graph.two_states(x), 10) - 40) <= 1


def test_votes(spark):
    bins = spark.createDataFrame([(1, k, s, 0, 1, 1.0, k) for k, s in enumerate("a" * 4 + "b" * 2 + "c" * 100)], BINS)
    grouped = spark.createDataFrame([(1, k, 1 if k in (0, 1, 2, 4) or 6 <= k < 57 else 2) for k in range(106)], "map_id int, bin_id long, group_id int")
    tallied = vote.tally(grouped, bins)
    assert {(r.scaffold, r.group_id) for r in tallied.where("assigned").collect()} == {("a", 1), ("c", 1)}  # b is split and vanishes
    assert vote.assigned_bins(tallied, bins).count() == 104
    r = vote.assess(tallied, bins).first()
    assert (r.n_bins, r.n_assigned, r.n_false) == (106, 104, 1 + 1 + 1 + 49)
    with pytest.raises(Exception, match="no size of scaffold"):
        vote.rank_groups(vote.assigned_bins(tallied, bins), spark.createDataFrame([("a", 1)], "scaffold string, size long")).collect()


def test_orientation_cases(spark):
    sizes = spark.createDataFrame([("A", 1000), ("m", 100), ("B", 1000), ("x", 100), ("C", 1000), ("D", 1000), ("y", 100), ("lone", 50)], "scaffold string, size long")
    rows = [(1, 1, "A", "+"), (1, 2, "m", "+"), (1, 3, "B", "+"), (2, 1, "x", "+"), (2, 2, "C", "-"), (3, 1, "D", "+"), (3, 2, "y", "+"), (4, 1, "lone", "-")]
    ordered = spark.createDataFrame(rows, "group_id long, ord int, scaffold string, orientation string").join(maps.with_bin_count(sizes, 100).select("scaffold", "is_small"), "scaffold")
    sites = sizes.select("scaffold", F.array().cast("array<bigint>").alias("coords"))
    pairs = [("m", 50, "A", 950)] * 3 + [("B", 50, "m", 10)] * 2 + [("m", 5, "B", 990)] * 1 + [("x", 20, "C", 950)] * 4 + [("x", 80, "C", 950)] + [("D", 990, "y", 10)] * 2 + [("D", 990, "y", 90)] * 5
    pairs = spark.createDataFrame(pairs, "s1 string, p1 long, s2 string, p2 long")
    got = {r.scaffold: r.orientation for r in orient.orient_small(ordered, sizes, sites, pairs, 100, 100).collect()}
    # m: (m, B) has a forward pair, so the two reverse ones are ignored, and it is far from the facing end; x: most links in its first half; y: in its second
    assert got == {"A": "+", "m": "-", "B": "+", "x": "-", "C": "-", "D": "+", "y": "-", "lone": "-"}


def test_edge_sites(spark):
    sites = spark.createDataFrame([("a", [5, 10, 11, 90, 91]), ("b", [5])], "scaffold string, coords array<bigint>")
    sizes = spark.createDataFrame([("a", 100), ("b", 8)], "scaffold string, size long")
    assert {r.scaffold: (r.res_left, r.res_right) for r in orient.edge_sites(sites, sizes, F.lit(10)).collect()} == {"a": (2, 1), "b": (1, 1)}


def test_joined_lines(spark):
    rng = random.Random(0)
    seqs = {f"n{k}": "".join(rng.choice("ACGTN") for _ in range(length)) for k, length in enumerate([0, 49, 50, 51, 7, 230, 3])}
    df = spark.createDataFrame([(n, s, k) for k, (n, s) in enumerate(seqs.items())], "name string, seq string, ord int")
    given = spark.createDataFrame([(1, 1, "n1", "+"), (1, 2, "n0", "-"), (1, 3, "n3", "-"), (2, 1, "n5", "+")], "group_id int, ord int, scaffold string, orientation string")
    got = join_sequences(given, df).toPandas().sort_values(["name", "line_no"]).groupby("name")["line"].apply(list)
    turn = str.maketrans("ACGTN", "TGCAN")
    whole = {"Chr_1": seqs["n1"] + "N" * 100 + "N" * 100 + seqs["n3"].translate(turn)[::-1], "Chr_2": seqs["n5"], **{n: seqs[n] for n in ("n2", "n4", "n6")}}
    assert {n: "".join(x) for n, x in got.items()} == whole
    assert all(len(x) == 50 for lines in got for x in lines[:-1])
    stats = emit.assembly_statistics(given.withColumnRenamed("scaffold", "name"), df).first()
    assert (stats.n_joined, stats.n_left, stats.gap_ns, stats.joined_length + stats.left_length) == (4, 3, 200, sum(map(len, seqs.values())))
    with pytest.raises(Exception, match="no sequence of"):
        emit.oriented(spark.createDataFrame([(1, 1, "zz", "+")], "group_id int, ord int, name string, orientation string"), df).collect()


def test_text_formats(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a", "+"), (1, 2, "b", "-"), (2, 1, "c", "+")], "group_id int, ord int, scaffold string, orientation string")
    text.write_lines(text.section_lines(rows, ["scaffold", "orientation"], "Chromosome grouping"), str(tmp_path / "order"), "group_id", "at")
    lines = text.numbered_lines(spark, str(tmp_path / "order"))
    assert sorted(map(tuple, text.read_order(lines).collect())) == [(1, 1, "a", "+"), (1, 2, "b", "-"), (2, 1, "c", "+")]
    (tmp_path / "x.fa").write_text(">one two\r\nACGT\r\nAC\n>b\n\n>c\nTT\n>b\nGG\n")
    assert {r.name: r.seq for r in text.read_fasta(spark, str(tmp_path / "x.fa")).collect()} == {"one two": "ACGTAC", "b": "GG", "c": "TT"}
    text.write_fasta(spark.createDataFrame([("q", 0, "AC"), ("q", 1, "G")], "name string, line_no long, line string"), str(tmp_path / "out.fa"))
    assert {r.name: r.seq for r in text.read_fasta(spark, str(tmp_path / "out.fa")).collect()} == {"q": "ACG"}
    (tmp_path / "m.tsv").write_text("1\t2\t3.5\n")
    assert text.read_table(spark, str(tmp_path / "m.tsv"), "contacts").first()[:] == (1, 2, 3.5)


def test_readers_edge_rows(spark):
    bins = spark.createDataFrame([(k, f" S{k}\r" if k < 3 else "t", 0, 1, k, 1) for k in range(1, 7)], "line_no long, scaffold string, start long, stop long, bin_id long, map_id int")
    biases = spark.createDataFrame([(1, "0.5"), (2, "nan"), (3, "NaN"), (4, "abc"), (5, None)], "line_no long, bias_txt string")
    sizes = spark.createDataFrame([(1, "s1", 10), (2, "s1", 20), (3, "t", None)], "line_no long, scaffold string, size long")
    got = {r.bin_id: (r.scaffold, r.bias) for r in maps.read_bins(bins, biases, sizes).collect()}
    assert got[1] == ("s1", 0.5) and 2 not in got and math.isnan(got[3][1]) and got[4] == ("t", 0.0) and got[5] == ("t", 0.0) and got[6] == ("t", 0.0)
    rows = [(1, 3, 2.0, 1), (3, 1, 5.0, 2), (1, 99, 4.0, 1), (4, 4, 1.0, 1), (5, 6, float("nan"), 1), (5, 4, 3.0, 1), (5, 4, 0.0, 2), (None, 1, 1.0, 1)]
    contacts = spark.createDataFrame(rows, "b1 long, b2 long, v double, loaded_at int").withColumn("map_id", F.lit(1))
    cells = maps.read_contacts(contacts, maps.read_bins(bins, biases, sizes))
    assert sorted((r.i, r.j, r.v) for r in cells.collect()) == [(1, 3, 5.0), (4, 4, 1.0)]
    assert maps.symmetric(cells).count() == 3
    assert {r.scaffold: r["size"] for r in maps.read_sizes(sizes).collect()} == {"s1": 20, "t": None}


def test_empty_map(spark):
    bins, cells, _, _ = planted_frames(spark, groups=1, scaffolds=1, bins=2)
    none = find_groups(bins.limit(0), cells.limit(0), spark.createDataFrame([], "scaffold string, size long"), Config(restarts=1))
    assert none.count() == 0


def test_config():
    config = parse_config("# comment\n\nresolution = 500000\npsig = 2\nlook_ahead = False\nmin_size = x\nrestarts = 3\n")
    assert (config.resolution, config.psig, config.look_ahead, config.min_size, config.restarts) == (500_000, 0.05, None, 5, 3)
    assert "fasta_file" in missing(config, (1, 4)) and "resolution" not in missing(config, (1,))
    with pytest.raises(ValueError):
        parse_config("resolution = big")


def test_cut_kernel_on_planted_map():
    _, m, true = planted(weak=0.001)
    at = np.argsort(true)
    m = m[np.ix_(at, at)]
    lf = np.r_[0.0, np.cumsum(np.log(np.arange(1, len(m) + 1)))]
    ranks = cuts.rank_order(m)
    assert pd.Series(cuts.denoise(ranks, cuts.leftmost_cuts(ranks, 5, 0.05, 0.05, lf), 0.05, lf)).isin([20, 40]).all()
