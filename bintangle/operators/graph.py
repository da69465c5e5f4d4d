"""Community structure of a map: average linkage, seeded modularity communities, two-state segmentation.

The modularity of a partition is relational. The sequential kernels run per map, or per map and restart, in co-grouped pandas functions, so maps and restarts
run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bintangle.operators.cuts import dense
from bintangle.session import durable, spread

#: Restarts that one task makes of the contacts of a map, which it gets once.
PER_TASK = 5


def average_linkage(d: np.ndarray) -> list[int]:
    """Leaf order of average-linkage clustering of a symmetric distance matrix: nearest-neighbour chains; at each merge the smaller cluster comes first, equal ones by lesser leaf."""
    n = len(d)
    d = d.copy()
    np.fill_diagonal(d, np.inf)
    leaves, alive, chain = {k: [k] for k in range(n)}, np.ones(n, bool), []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            b = int(np.argmin(np.where(alive, d[a], np.inf)))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
                break
            chain.append(b)
        chain = chain[:-2]
        p, q = leaves.pop(a), leaves.pop(b)
        row = (len(p) * d[a] + len(q) * d[b]) / (len(p) + len(q))
        d[a], d[:, a] = row, row
        d[a, a], alive[b] = np.inf, False
        leaves[a] = p + q if (len(p), min(p)) <= (len(q), min(q)) else q + p
    return leaves.popitem()[1] if n else []


def leaf_order(n_bins: DataFrame, distance_cells: DataFrame) -> DataFrame:
    """``map_id``, ``at`` (old place), ``pos`` (new place). Only distances above the diagonal count; cells that are not there have distance 2."""

    def run(size: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(size):
            return pd.DataFrame({"map_id": [], "at": [], "pos": []})
        n = int(size["n"].iloc[0])
        upper = dense(n, own.assign(v=own["d"] - 2))
        order = average_linkage(2 + upper + upper.T)
        return pd.DataFrame({"map_id": size["map_id"].iloc[0], "at": order, "pos": range(n)})

    return spread(n_bins, "map_id").cogroup(spread(distance_cells.where("i < j"), "map_id")).applyInPandas(run, "map_id int, at bigint, pos bigint")


def louvain(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, seed: int) -> np.ndarray:
    """Communities by local moves and aggregation in a seeded random order; ``i`` <= ``j``."""
    rng, member, total = np.random.default_rng(seed), np.arange(n), w.sum()
    while total > 0:
        m = np.zeros((n, n))
        np.add.at(m, (i, j), w)
        np.add.at(m, (j, i), np.where(i == j, 0.0, w))
        degree = m.sum(1) + np.diag(m)
        label, strength, moved_any = np.arange(n), degree.copy(), False
        links = [x[x != k] for k, x in enumerate(map(np.flatnonzero, m))]
        weights = [m[k, x] for k, x in enumerate(links)]
        moved = True
        while moved:
            moved = False
            for k in rng.permutation(n):
                own = best = label[k]
                strength[own] -= degree[k]
                near = label[links[k]]
                if len(near):
                    to = np.bincount(near, weights[k], minlength=n)
                    gain = to[near] - strength[near] * degree[k] / (2 * total)
                    most = gain.max()
                    if most > to[own] - strength[own] * degree[k] / (2 * total) + 1e-12:
                        best = near[gain == most].min()
                strength[best] += degree[k]
                if best != own:
                    label[k], moved, moved_any = best, True, True
        if not moved_any:
            break
        _, label = np.unique(label, return_inverse=True)
        member, n = label[member], int(label.max()) + 1
        a, b = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        code, at = np.unique(a * n + b, return_inverse=True)
        i, j, w = code // n, code % n, np.bincount(at, w)
    return member


def modularity(partition: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, ``modularity`` of a partition (``keys``, ``bin_id``, ``community``) of ``edges`` (``map_id``, ``i`` <= ``j``, ``v``): inner weight less squared degree."""
    at = lambda k: partition.select(*keys, F.col("bin_id").alias(k), F.col("community").alias(f"c_{k}"))
    labelled = edges.join(at("i"), [*({"map_id"} & set(keys)), "i"]).join(at("j"), [*keys, "j"])
    ends = labelled.select(*keys, "v", F.explode(F.array("c_i", "c_j")).alias("community"), (F.col("c_i") == F.col("c_j")).alias("inner"))
    # each edge comes twice, once for each end
    community = ends.groupBy(*keys, "community").agg(F.sum("v").alias("degree"), (F.sum(F.when(F.col("inner"), F.col("v")).otherwise(0.0)) / 2).alias("inside"))
    total = community.groupBy(*keys).agg((F.sum("degree") / 2).alias("m"))
    parts = community.join(total, keys).select(*keys, (F.col("inside") / F.col("m") - F.pow(F.col("degree") / (2 * F.col("m")), F.lit(2))).alias("q"))
    return parts.groupBy(*keys).agg(F.sum("q").alias("modularity"))


def partition_modularity(member: np.ndarray, i: np.ndarray, j: np.ndarray, w: np.ndarray) -> float:
    """:func:`modularity` of one partition of a map in arrays; 0 without contacts."""
    degree = np.bincount(member[i], w, len(member)) + np.bincount(member[j], w, len(member))
    total = w.sum()
    return float(w[member[i] == member[j]].sum() / total - ((degree / (2 * total)) ** 2).sum()) if total > 0 else 0.0


def communities(places: DataFrame, edges: DataFrame, restarts: int = 20, seed: int = 0) -> DataFrame:
    """``map_id``, ``bin_id``, ``pos``, ``community``: the restart of the best modularity, the first among equals. Bins without contacts are communities of their own."""
    turns = F.explode(F.sequence(F.lit(0), F.lit((restarts - 1) // PER_TASK))).alias("part")
    nodes, own = places.select("map_id", "bin_id", "pos", turns), edges.select("map_id", "i", "j", "v", turns)

    def run(members: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        if not len(members):
            return pd.DataFrame({c: [] for c in ("map_id", "restart", "modularity", "bin_id", "pos", "community")})
        members = members.sort_values("pos", ignore_index=True)
        index = pd.Series(np.arange(len(members)), members["bin_id"])
        i, j, w = index[links["i"]].to_numpy(), index[links["j"]].to_numpy(), links["v"].to_numpy()
        i, j, first, best = np.minimum(i, j), np.maximum(i, j), int(members["part"].iloc[0]) * PER_TASK, None
        for restart in range(first, min(first + PER_TASK, restarts)):
            found = louvain(len(members), i, j, w, seed + restart)
            q = round(partition_modularity(found, i, j, w), 12)
            if best is None or q > best[0]:
                best = q, restart, found
        members["modularity"], members["restart"], members["community"] = best
        return members[["map_id", "restart", "modularity", "bin_id", "pos", "community"]]

    keys = ["map_id", "part"]
    tried = durable(spread(nodes, *keys).cogroup(spread(own, *keys)).applyInPandas(run, "map_id int, restart int, modularity double, bin_id bigint, pos bigint, community bigint"))  # read twice
    best = tried.groupBy("map_id").agg(F.max_by("restart", F.struct("modularity", -F.col("restart"))).alias("restart"))
    return tried.join(best, ["map_id", "restart"], "left_semi").select("map_id", "bin_id", "pos", "community")


def tail_cuts(places: DataFrame, edges: DataFrame, cuts: DataFrame, restarts: int = 20) -> DataFrame:
    """Communities of the bins behind the last cut: ``map_id``, ``bin_id``, ``pos`` (re-ordered by falling community size) and ``group_id``."""
    last = cuts.groupBy("map_id").agg(F.max("cut").alias("last"), F.count("*").alias("n_cuts"))
    marked = places.join(last, "map_id", "left").fillna(0, ["last", "n_cuts"])
    behind = marked.where("pos >= last").select("map_id", "bin_id", "pos")
    inner = edges.join(behind.select(F.col("bin_id").alias("i")), "i", "left_semi").join(behind.select(F.col("bin_id").alias("j")), "j", "left_semi")
    found = communities(behind, inner, restarts)
    sized = found.groupBy("map_id", "community").agg(F.count("*").alias("n"), F.min("pos").alias("seen"))
    ranked = sized.select("map_id", "community", F.row_number().over(Window.partitionBy("map_id").orderBy(F.desc("n"), "seen")).alias("place"))
    tail = found.join(ranked, ["map_id", "community"]).join(marked.select("bin_id", "last", "n_cuts"), "bin_id")
    tail = tail.withColumn("new", F.col("last") + F.row_number().over(Window.partitionBy("map_id").orderBy("place", "pos")) - 1)
    from bintangle.operators.cuts import groups_from_cuts

    head = groups_from_cuts(marked.where("pos < last").select("map_id", "bin_id", "pos"), cuts)
    return head.select("map_id", "bin_id", "pos", "group_id").unionByName(tail.select("map_id", "bin_id", F.col("new").alias("pos"), (F.col("n_cuts") + F.col("place")).alias("group_id")))


def two_states(x: np.ndarray, rounds: int = 1000, tolerance: float = 1e-4) -> np.ndarray:
    """The likeliest path of a two-state Gaussian chain with diagonal covariance, fitted to the rows of ``x`` by expectation and maximisation. It starts in the first state; means, variances and moves are learned."""
    n, f = x.shape
    half = max(1, n // 2)
    mean = np.array([x[:half].mean(0), x[half:].mean(0) if n > half else x.mean(0)])
    var = np.tile(x.var(0) + 1e-3, (2, 1))
    start, move, before = np.array([1.0, 0.0]), np.array([[0.9, 0.1], [0.0001, 0.9999]]), -np.inf
    log_b = np.zeros((n, 2))

    def emit() -> np.ndarray:
        return np.stack([-0.5 * (((x - mean[s]) ** 2 / var[s]) + np.log(2 * np.pi * var[s])).sum(1) for s in (0, 1)], 1)

    for _ in range(rounds):
        log_b = emit()
        peak = log_b.max(1, keepdims=True)
        b = np.exp(log_b - peak)
        alpha, beta, scale = np.zeros((n, 2)), np.ones((n, 2)), np.zeros(n)
        for t in range(n):
            alpha[t] = (start if t == 0 else alpha[t - 1] @ move) * b[t] + 1e-300
            scale[t] = alpha[t].sum()
            alpha[t] /= scale[t]
        for t in range(n - 2, -1, -1):
            beta[t] = move @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
        gamma = alpha * beta
        gamma /= gamma.sum(1, keepdims=True)
        pair = np.einsum("ti,ij,tj->ij", alpha[:-1], move, b[1:] * beta[1:] / scale[1:, None]) * 1.0 if n > 1 else move
        move = (pair + 1e-12) / (pair + 1e-12).sum(1, keepdims=True)
        weight = gamma.sum(0)[:, None] + 1e-12
        mean = gamma.T @ x / weight
        var = gamma.T @ x**2 / weight - mean**2
        var = np.maximum(var, 1e-3)
        now = float(np.log(scale).sum() + peak.sum())
        if now - before < tolerance:
            break
        before = now
    log_b, log_move = emit(), np.log(move + 1e-300)
    path, back = np.log(start + 1e-300) + log_b[0], np.zeros((n, 2), int)
    for t in range(1, n):
        step = path[:, None] + log_move
        back[t], path = step.argmax(0), step.max(0) + log_b[t]
    states = np.zeros(n, int)
    states[-1] = path.argmax()
    for t in range(n - 2, -1, -1):
        states[t] = back[t + 1, states[t + 1]]
    return states


def boundary(states: np.ndarray, width: int) -> int | None:
    """The first of ``width`` consecutive places that all differ from what most of the first ``width`` are."""
    base = int(2 * states[:width].sum() > len(states[:width]))
    off = np.cumsum(np.r_[0, states != base])
    hit = np.flatnonzero(off[width:] - off[:-width] == width) if len(states) > width else np.array([])
    hit = hit[hit < len(states) - width]
    return int(hit[0]) if len(hit) else None


def _next_cut(m: np.ndarray, last: int, width: int, rounds: int, look_ahead: float | None) -> int | None:
    """One more cut behind ``last``: fitted on the columns up to the look-ahead, then up to the boundary found, until that stays or the rounds are over. A fit without boundary counts as 0; None if too little of the map is left."""
    n = len(m)
    ahead = n if look_ahead is None else last + int((n - last) * look_ahead)
    before = at = ahead
    for _ in range(rounds):
        if (n - last) / 2 < width:
            return None
        columns = m[last:, last:before]
        if columns.shape[1] < width:
            at = ahead
        else:
            found = boundary(two_states(columns), width)
            at = 0 if found is None else last + found
        if at == before:
            break
        before = at
    return at


def repeated_cuts(m: np.ndarray, width: int, rounds: int, look_ahead: float | None, frac: float, cuts: list[int] | None = None) -> list[int]:
    """Cuts of one map, behind those in ``cuts``. A last cut at the very end leaves nothing behind it: it is dropped, and if five times ``frac`` of the map are left, the rest is cut again
    with one round fewer, half the rest as look-ahead and the default width and share (fixed values 5 and .05)."""
    n, cuts = len(m), list(cuts or [0])
    if frac == 1:
        return []
    while cuts[-1] <= n - n * frac:
        at = _next_cut(m, cuts[-1], width, rounds, look_ahead)
        if at is None or at <= cuts[-1]:
            break
        cuts.append(at)
    if len(cuts) > 1 and cuts[-1] == n:
        cuts.pop()
        if n - cuts[-1] >= 5 * n * frac and rounds > 1:
            return repeated_cuts(m, 5, rounds - 1, 0.5, 0.05, cuts)
    return [c for c in cuts if c > 0]


def state_cuts(n_bins: DataFrame, log_values: DataFrame, width: int = 10, rounds: int = 8, look_ahead: float | None = 0.2, frac: float = 0.05) -> DataFrame:
    """``map_id``, ``cut`` by repeated two-state segmentation, until no boundary is found, or less than ``frac`` of the bins or two widths are left; none if ``frac`` is 1. ``log_values``: symmetric cells ``i``, ``j``, ``lg``."""

    def run(size: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(size):
            return pd.DataFrame({"map_id": [], "cut": []})
        cuts = repeated_cuts(dense(int(size["n"].iloc[0]), own, "lg"), width, rounds, look_ahead, frac)
        return pd.DataFrame({"map_id": [size["map_id"].iloc[0]] * len(cuts), "cut": cuts})

    return spread(n_bins, "map_id").cogroup(spread(log_values, "map_id")).applyInPandas(run, "map_id int, cut bigint")
