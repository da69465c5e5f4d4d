"""Cutting an ordered map into groups: iterated leftmost breakpoints and their denoising, per map.

Both are folds, each step starting where the last one ended, so each map is one group of a co-grouped pandas function; maps run in
parallel. The relational form of a single step is in :mod:`bintangle.operators.enrichment`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bintangle.session import spread

#: Terms of tails computed at once: 32 MB for each array.
AT_ONCE = 4_000_000


def dense(n: int, cells: pd.DataFrame, value: str = "v") -> np.ndarray:
    """The symmetric or row-wise matrix of one map from its cells at places ``i``, ``j``."""
    m = np.zeros((n, n))
    m[cells["i"].to_numpy(np.int64), cells["j"].to_numpy(np.int64)] = cells[value].to_numpy()
    return m


def rank_order(m: np.ndarray) -> np.ndarray:
    """Columns of each row by falling value, ties by falling column."""
    return m.shape[1] - 1 - np.argsort(-m[:, ::-1], axis=1, kind="stable")


def tail(x: np.ndarray, population: int, successes: np.ndarray, draws: np.ndarray, lf: np.ndarray) -> np.ndarray:
    """P(X >= x) of hypergeometric variables, NaN where draws or successes exceed the population; ``lf``: logarithms of factorials."""
    x, n, N = (a.ravel().astype(np.int64) for a in np.broadcast_arrays(x, successes, draws))
    least, most = np.maximum(0, n + N - population), np.minimum(n, N)
    out = np.where((n > population) | (N > population), np.nan, np.where(x > most, 0.0, 1.0))
    live = np.flatnonzero((out == 1) & (x > least))
    ends = np.cumsum(most[live] - x[live] + 1)
    for own in np.split(live, np.searchsorted(ends, np.arange(AT_ONCE, ends[-1], AT_ONCE)) if len(live) else []):
        if not len(own):
            continue
        size = most[own] - x[own] + 1
        first = np.cumsum(size) - size
        k = np.arange(size.sum()) - np.repeat(first - x[own], size)
        a, b = np.repeat(n[own], size), np.repeat(N[own], size)
        terms = lf[a] - lf[k] - lf[a - k] + lf[population - a] - lf[b - k] - lf[population - a - b + k] - (lf[population] - lf[b] - lf[population - b])
        out[own] = np.minimum(1.0, np.add.reduceat(np.exp(terms), first))
    return out


def _inside(ranks: np.ndarray, start: int) -> np.ndarray:
    """Of each row behind start, how many of as many first ranks as it is away lie between start and the row."""
    n, parts = len(ranks), []
    for at in range(start + 1, n, 512):
        rows = np.arange(at, min(n, at + 512))
        r = ranks[rows, : n - start - 1]
        parts.append(((r >= start) & (r <= rows[:, None]) & (np.arange(r.shape[1]) < rows[:, None] - start)).sum(1))
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def _first_break(ranks: np.ndarray, start: int, width: int, world: int, psig: float, lf: np.ndarray) -> int | None:
    c, x = np.arange(1, len(ranks) - start), _inside(ranks, start)
    for _ in range(5):
        flags = np.r_[0, ~(tail(x, world, c, c, lf) >= psig)].astype(int)  # NaN counts as significant
        if flags.mean() < 0.9 or start == 0:
            break
        world = int(world - start)
    contrast = np.correlate(flags, np.r_[np.ones(width), -np.ones(width)], "valid") if len(flags) >= 2 * width else np.array([])
    hit = np.flatnonzero(contrast == width)
    return int(hit[0]) + width if len(hit) else None


def leftmost_cuts(ranks: np.ndarray, width: int, frac: float, psig: float, lf: np.ndarray) -> list[int]:
    n, start, cuts = len(ranks), 0, []
    if frac == 1:
        return []
    while start < int(n - n * frac) and n - start > width:
        k = _first_break(ranks, start, width, n - start, psig, lf)
        if k is None:
            break
        start += k
        cuts.append(start)
    return cuts


def denoise(ranks: np.ndarray, cuts: list[int], psig: float, lf: np.ndarray) -> list[int]:
    """Cuts that no later segment is linked across, found again and again until they stay."""
    n, horizon = len(ranks), len(ranks) // 5
    current = sorted(cuts)
    for _ in range(10 * max(1, len(cuts))):
        accepted, rest, start = set(), current, 0
        while True:
            world, linked_at = n - start, None
            for c in rest:
                size = c - start
                rows = np.arange(start, min(n, start + horizon + 1))
                x = ((ranks[rows, :size] >= start) & (ranks[rows, :size] <= c)).sum(1)
                flags = np.zeros(n, int)
                flags[rows] = tail(x, world, np.full(len(rows), size), np.full(len(rows), size), lf) < psig
                before, linked = start, []
                for k, a in enumerate(rest):
                    if a == before:
                        continue
                    p = tail(np.array([flags[before:a].sum()]), world, np.array([size]), np.array([a - before]), lf)[0]
                    if p < psig:
                        linked.append(k)
                    before = a
                if linked and rest[linked[-1]] > start:
                    linked_at = linked[-1]
                    break
                accepted.add(c)
            if linked_at is None:
                break
            start = rest[linked_at]
            accepted.add(start)
            rest = rest[linked_at:]
        kept = sorted(accepted)
        if kept == current:
            break
        current = kept
    return current


def find_cuts(n_bins: DataFrame, cells: DataFrame, width: int = 5, frac: float = 0.05, psig: float = 0.05, clean: bool = True) -> DataFrame:
    """``map_id``, ``cut``: places where a new group begins. ``cells``: symmetric, at places of the ordered map; ``n_bins``: ``map_id``, ``n``.

    The cutting pass uses the fixed level .05, whatever ``psig`` is; ``psig`` is that of denoising.
    """
    return _cuts(n_bins, cells, width, frac, psig, (clean,)).select("map_id", "cut")


def find_both(n_bins: DataFrame, cells: DataFrame, width: int = 5, frac: float = 0.05, psig: float = 0.05) -> DataFrame:
    """``map_id``, ``cut``, ``clean``: the cuts of :func:`find_cuts` before denoising and after it, with the cells moved and ranked once."""
    return _cuts(n_bins, cells, width, frac, psig, (False, True))


def _cuts(n_bins: DataFrame, cells: DataFrame, width: int, frac: float, psig: float, passes: tuple[bool, ...]) -> DataFrame:
    def run(size: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(size):
            return pd.DataFrame({"map_id": [], "cut": [], "clean": []})
        n = int(size["n"].iloc[0])
        lf = np.r_[0.0, np.cumsum(np.log(np.arange(1, n + 1)))]
        ranks = rank_order(dense(n, own))
        cuts = leftmost_cuts(ranks, width, frac, 0.05, lf)
        found = [(c, clean) for clean in passes for c in (denoise(ranks, cuts, psig, lf) if clean else cuts)]
        return pd.DataFrame({"map_id": [size["map_id"].iloc[0]] * len(found), "cut": [c for c, _ in found], "clean": [clean for _, clean in found]})

    return spread(n_bins, "map_id").cogroup(spread(cells, "map_id")).applyInPandas(run, "map_id int, cut bigint, clean boolean")


def groups_from_cuts(places: DataFrame, cuts: DataFrame) -> DataFrame:
    """``map_id``, ``bin_id``, ``pos``, ``group_id``: 1 plus the number of cuts at or below the place. A running sum over the united places and cuts, no range join."""
    marks = places.select("map_id", "pos", F.col("bin_id"), F.lit(0).alias("is_cut")).unionByName(cuts.select("map_id", F.col("cut").alias("pos"), F.lit(None).cast("bigint").alias("bin_id"), F.lit(1).alias("is_cut")))
    w = Window.partitionBy("map_id").orderBy("pos", F.desc("is_cut")).rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("group_id", (F.sum("is_cut").over(w) + 1).cast("bigint")).where("is_cut = 0").select("map_id", "bin_id", "pos", "group_id")
