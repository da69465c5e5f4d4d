"""Order and orientation of the scaffolds of a group: score in closed form, candidates, and the search.

The score of an order weighs each contact at distance d by H(n - 1) - H(d - 1), H the harmonic numbers, over the total weight: the mean of the running means of the
diagonals. It only needs the edges, so a candidate costs as many steps as the group has contacts. Groups are independent and searched in parallel.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bintangle.functions.special import harmonic, search_space
from bintangle.session import durable, join_dictionary, spread

#: Scaffolds tried in every order at first; more than this cannot be searched.
MOST_SCAFFOLDS = 8
#: Distances computed at once: 32 MB.
AT_ONCE = 4_000_000


def group_scaffolds(assigned: DataFrame) -> DataFrame:
    """Scaffolds of each group, most bins first, then by first bin: ``map_id``, ``group_id``, ``scaffold``, ``bin_ids``, ``node_count``, ``place``."""
    built = assigned.groupBy("map_id", "group_id", "scaffold").agg(F.sort_array(F.collect_list("bin_id")).alias("bin_ids"), F.count("*").alias("node_count"))
    return built.withColumn("place", F.row_number().over(Window.partitionBy("map_id", "group_id").orderBy(F.desc("node_count"), F.col("bin_ids")[0])))


def flip(scaffolds: DataFrame) -> DataFrame:
    """Bins in reading order: reversed where ``orientation`` is -."""
    return scaffolds.withColumn("bin_ids", F.when(F.col("orientation") == "-", F.reverse("bin_ids")).otherwise(F.col("bin_ids")))


def flatten_order(scaffolds: DataFrame) -> DataFrame:
    """Places of all bins under an order (``ord``) and orientation: ``map_id``, ``group_id``, ``bin_id``, ``pos`` from 0, by the offset of each scaffold."""
    w = Window.partitionBy("map_id", "group_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    placed = scaffolds.withColumn("offset", F.coalesce(F.sum("node_count").over(w), F.lit(0)))
    out = placed.select("map_id", "group_id", "offset", "node_count", "orientation", F.posexplode("bin_ids").alias("k", "bin_id"))
    return out.select("map_id", "group_id", "bin_id", (F.col("offset") + F.when(F.col("orientation") == "-", F.col("node_count") - 1 - F.col("k")).otherwise(F.col("k"))).alias("pos"))


def inner_weights(cells: DataFrame, places: DataFrame) -> DataFrame:
    """Contacts within a group with the distance of their places: ``map_id``, ``group_id``, ``d``, ``v``; ``cells`` has each pair once."""
    at = lambda k: places.select(F.col("bin_id").alias(k), F.col("group_id").alias(f"g_{k}"), F.col("pos").alias(f"pos_{k}"))
    n = places.count()
    both = join_dictionary(join_dictionary(cells.where("i <> j"), at("i"), "i", rows=n, hot=False), at("j"), "j", rows=n, hot=False).where("g_i = g_j")
    return both.select("map_id", F.col("g_i").alias("group_id"), F.abs(F.col("pos_i") - F.col("pos_j")).alias("d"), "v")


def score_orders(cells: DataFrame, places: DataFrame) -> DataFrame:
    """``map_id``, ``group_id``, ``total``, ``score`` of an order; weights are summed by distance first, so the harmonic numbers are computed once for each."""
    places = durable(places)
    n = places.groupBy("map_id", "group_id").agg(F.count("*").alias("n"))
    by_distance = inner_weights(cells, places).groupBy("map_id", "group_id", "d").agg(F.sum("v").alias("v"))
    weight = harmonic(F.col("n") - 1) - harmonic(F.col("d") - 1)
    return by_distance.join(n, ["map_id", "group_id"]).groupBy("map_id", "group_id").agg(F.sum("v").alias("total"), (F.sum(F.col("v") * weight) / F.sum("v")).alias("score"))


def candidate_counts(scaffolds: DataFrame) -> DataFrame:
    """``n`` scaffolds of each group and how many orders and orientations there are up to reversal: a double, infinite beyond its range."""
    return scaffolds.groupBy("map_id", "group_id").agg(F.count("*").alias("n")).withColumn("candidates", search_space(F.col("n")))


def orientations(n: int) -> list[tuple[int, ...]]:
    """All patterns of + (0) and - (1), all plus first."""
    return [tuple(code >> k & 1 for k in range(n)) for code in range(2**n)]


def orders(n: int, both_ways: bool = False) -> list[tuple[int, ...]]:
    """Permutations, one of each and its reverse unless ``both_ways``."""
    return [p for p in permutations(range(n)) if both_ways or p <= p[::-1]]


@lru_cache
def _patterns(n: int, both_ways: bool) -> tuple:
    """All orders and signs of a window of ``n``; of each scaffold the sets that can stand before it, of each two of them those that can stand between them (-1: in the other direction), as rows, with the row of every order. Last, which signs have
    each turn of one (two columns a scaffold) and of two (four columns a pair)."""
    listed = np.array(orders(n, both_ways))
    rank = np.argsort(listed, axis=1)
    before = (rank[:, None, :] < rank[:, :, None]).astype(np.int64)
    rows = lambda x: tuple(np.unique(x, axis=0, return_inverse=True))
    ones = [rows(before[:, a]) for a in range(n)]
    twos = {(a, b): rows(before[:, b] - before[:, a]) for a in range(n) for b in range(a + 1, n)}
    signs = np.array(orientations(n))
    turns = np.concatenate([*(signs[:, a] == np.arange(2)[:, None] for a in range(n)), *(2 * signs[:, a] + signs[:, b] == np.arange(4)[:, None] for a, b in twos)]).astype(float)
    return listed, signs, ones, twos, turns


class _Group:
    """The contacts of one group over its scaffolds."""

    def __init__(self, sizes: np.ndarray, scaffold: np.ndarray, inner: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray) -> None:
        self.sizes, self.v = sizes, v
        self.scaffold_i, self.scaffold_j, self.inner_i, self.inner_j = scaffold[i], scaffold[j], inner[i], inner[j]
        self.passed = np.r_[0.0, 0.0, np.cumsum(1 / np.arange(1, int(sizes.sum()) + 1))]  # H(d - 1) at d

    def _each(self, offset: np.ndarray, minus: np.ndarray, live: np.ndarray) -> np.ndarray:
        """For every order (rows of ``offset``) and signs (rows of ``minus``), the sum of v H(d - 1), contact by contact."""
        si, sj, v = self.scaffold_i[live], self.scaffold_j[live], self.v[live]
        out, step = np.zeros((len(offset), len(minus))), max(1, AT_ONCE // max(1, len(v)))
        for k, turned in enumerate(minus):
            i = np.where(turned[si], self.sizes[si] - 1 - self.inner_i[live], self.inner_i[live])
            j = np.where(turned[sj], self.sizes[sj] - 1 - self.inner_j[live], self.inner_j[live])
            for at in range(0, len(offset), step):
                part = offset[at : at + step]
                out[at : at + step, k] = self.passed[np.abs(part[:, si] + i - part[:, sj] - j)] @ v
        return out

    def _by_pairs(self, offset: np.ndarray, minus: np.ndarray, live: np.ndarray) -> np.ndarray:
        """The same by scaffolds that move or turn: what two of them add depends on the gap between them and their signs only, and what one adds with all that stay, on its own place and sign."""
        moving = (offset != offset[0]).any(0) | (minus != minus[0]).any(0)
        si, sj, v = self.scaffold_i[live], self.scaffold_j[live], self.v[live]
        i, j = self.inner_i[live], self.inner_j[live]
        turned = minus[0] == 1
        x, y = (offset[0][s] + np.where(turned[s], self.sizes[s] - 1 - k, k) for s, k in ((si, i), (sj, j)))
        still = (~moving[si] & ~moving[sj]) | (si == sj)
        out = np.full((len(offset), len(minus)), self.passed[np.abs(x[still] - y[still])] @ v[still])
        movers = np.flatnonzero(moving)
        for k, s in enumerate(movers):
            on_i, on_j = (si == s) & ~moving[sj], (sj == s) & ~moving[si]
            own, other, weight = np.r_[i[on_i], j[on_j]], np.r_[y[on_i], x[on_j]], np.r_[v[on_i], v[on_j]]
            if len(own):
                places, at = np.unique(offset[:, s], return_inverse=True)
                two = np.stack([self.passed[np.abs(places[:, None] + (self.sizes[s] - 1 - own if a else own) - other)] @ weight for a in (0, 1)], 1)
                out += two[at][:, minus[:, s]]
            for t in movers[k + 1 :]:
                on_i, on_j = (si == s) & (sj == t), (sj == s) & (si == t)
                own, other, weight = np.r_[i[on_i], j[on_j]], np.r_[j[on_i], i[on_j]], np.r_[v[on_i], v[on_j]]
                if len(own):
                    gaps, at = np.unique(offset[:, t] - offset[:, s], return_inverse=True)
                    four = np.stack([self.passed[np.abs(gaps[:, None] + (self.sizes[t] - 1 - other if b else other) - (self.sizes[s] - 1 - own if a else own))] @ weight for a in (0, 1) for b in (0, 1)], 1)
                    out += four[at][:, 2 * minus[:, s] + minus[:, t]]
        return out

    def best(self, order_list: list[tuple[int, ...]], sign_list: list[dict[int, int]]) -> tuple[float, tuple[int, ...], dict[int, int]]:
        """The first best of all pairs of an order and the signs of its scaffolds, scores being equal to 12 digits; contacts of scaffolds outside the orders do not count."""
        order_at = np.array(order_list)
        used = np.zeros(len(self.sizes), bool)
        used[order_at[0]] = True
        live = used[self.scaffold_i] & used[self.scaffold_j]
        total, n = self.v[live].sum(), int(self.sizes[order_at[0]].sum())
        if total == 0 or n < 2:
            return 0.0, order_list[0], sign_list[0]
        offset = np.zeros((len(order_at), len(self.sizes)), np.int64)
        ends = np.cumsum(self.sizes[order_at], axis=1)
        np.put_along_axis(offset, order_at, ends - self.sizes[order_at], axis=1)
        minus = np.array([[sign.get(s, 0) for s in range(len(self.sizes))] for sign in sign_list], np.int64)
        few = len(order_list) * len(sign_list) <= 8  # cheaper contact by contact
        passed = self._each(offset, minus.astype(bool), live) if few else self._by_pairs(offset, minus, live)
        scores = np.round(self.passed[n] - passed / total, 12).T.ravel()
        k = int(np.argmax(scores))
        if scores[k] <= 0:
            return 0.0, order_list[0], sign_list[0]
        return float(scores[k]), order_list[k % len(order_list)], sign_list[k // len(order_list)]

    def _places(self, order: list[int], sign: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first place of each scaffold of an order, and the places of both ends of each contact."""
        offset, turned = np.zeros(len(self.sizes), np.int64), np.zeros(len(self.sizes), bool)
        offset[order] = np.cumsum(self.sizes[order]) - self.sizes[order]
        turned[[s for s in order if sign.get(s)]] = True
        x, y = (offset[s] + np.where(turned[s], self.sizes[s] - 1 - k, k) for s, k in ((self.scaffold_i, self.inner_i), (self.scaffold_j, self.inner_j)))
        return offset, x, y

    def _sums(self, gaps: np.ndarray, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """For every gap and row of ``at``, the sum of ``weight`` H(d - 1), d being the gap and the places together."""
        out, step = np.zeros((len(gaps), len(at))), max(1, AT_ONCE // (len(gaps) * len(at)))
        for k in range(0, len(weight), step):
            out += self.passed[np.abs(gaps[:, None, None] + at[:, k : k + step])] @ weight[k : k + step]
        return out

    def insert(self, order: list[int], sign: dict[int, int], new: int) -> tuple[float, list[int], int]:
        """The first best place of ``new`` in an order, and whether it is turned there; at every other place it is tried turned first. Contacts of the others only get longer by its size, if it comes between their scaffolds."""
        m, size, start = len(order), int(self.sizes[new]), sign.get(new, 0)
        rank = np.full(len(self.sizes), -1)
        rank[order] = np.arange(m)
        _, x, y = self._places(order, sign)
        ri, rj, v = rank[self.scaffold_i], rank[self.scaffold_j], self.v
        old = (ri >= 0) & (rj >= 0)
        on_i, on_j, own = (self.scaffold_i == new) & (rj >= 0), (self.scaffold_j == new) & (ri >= 0), (self.scaffold_i == new) & (self.scaffold_j == new)
        total, n = v[old | on_i | on_j | own].sum(), int(self.sizes[order].sum()) + size
        scores = np.zeros((m + 1, 2))
        if total > 0 and n >= 2:
            d, w = np.abs(x - y)[old], v[old]
            longer = (self.passed[d + size] - self.passed[d]) * w
            low, high = np.minimum(ri, rj)[old], np.maximum(ri, rj)[old]
            kept = self.passed[d] @ w + self.passed[np.abs(self.inner_i - self.inner_j)[own]] @ v[own]
            passed = np.repeat(kept + np.cumsum(np.bincount(low + 1, longer, m + 2) - np.bincount(high + 1, longer, m + 2))[: m + 1, None], 2, axis=1)
            inner, other, behind, w = np.r_[self.inner_i[on_i], self.inner_j[on_j]], np.r_[y[on_i], x[on_j]], np.r_[rj[on_i], ri[on_j]], np.r_[v[on_i], v[on_j]]
            first = np.r_[0, np.cumsum(self.sizes[order])]
            step = max(1, AT_ONCE // (2 * m + 2))
            for k in range(0, len(w), step):
                e = slice(k, k + step)
                there = other[e] + size * (behind[e] >= np.arange(m + 1)[:, None]) - first[:, None]
                passed += np.stack([self.passed[np.abs(i - there)] @ w[e] for i in (inner[e], size - 1 - inner[e])], 1)
            scores = np.maximum(np.round(self.passed[n] - passed / total, 12), 0)
        turn = (start + np.arange(m + 1)[:, None] + [0, 1]) % 2  # the flipped scaffold is tried as it is at the next place
        k = int(np.argmax(np.take_along_axis(scores, turn, axis=1)))
        at, turned = k // 2, int(turn.ravel()[k])
        return float(scores[at, turned]), [*order[:at], new, *order[at:]], turned

    def window(self, order: list[int], sign: dict[int, int], at: int, scan: int, both_ways: bool) -> tuple[float, list[int], dict[int, int]]:
        """The first best of all orders and signs of the ``scan`` scaffolds from ``at`` on, all others staying (see :meth:`best`)."""
        listed, signs, ones, twos, turns = _patterns(scan, both_ways)
        inside, total, n = order[at : at + scan], self.v.sum(), int(self.sizes.sum())
        if total == 0 or n < 2:
            return 0.0, order, sign
        offset, x, y = self._places(order, sign)
        sizes, local = self.sizes[inside], np.full(len(self.sizes), -1)
        local[inside] = np.arange(scan)
        a, b, v = local[self.scaffold_i], local[self.scaffold_j], self.v
        still = ((a < 0) & (b < 0)) | (self.scaffold_i == self.scaffold_j)
        each = np.zeros((len(listed), len(turns)))
        on_i, on_j = (a >= 0) & (b < 0), (b >= 0) & (a < 0)
        who, own, other, w = np.r_[a[on_i], b[on_j]], np.r_[self.inner_i[on_i], self.inner_j[on_j]], np.r_[y[on_i], x[on_j]], np.r_[v[on_i], v[on_j]]
        for s, (sets, row) in enumerate(ones):
            if len(mine := np.flatnonzero(who == s)):
                k, there = own[mine], other[mine]
                each[:, 2 * s : 2 * s + 2] = self._sums(offset[inside[0]] + sets @ sizes, np.stack([k - there, sizes[s] - 1 - k - there]), w[mine])[row]
        both = np.flatnonzero(~still & (a >= 0) & (b >= 0))
        less = a[both] < b[both]
        s, t = np.where(less, a[both], b[both]), np.where(less, b[both], a[both])
        own, other = np.where(less, self.inner_i[both], self.inner_j[both]), np.where(less, self.inner_j[both], self.inner_i[both])
        pair, w, own_back, other_back = s * scan + t, v[both], sizes[s] - 1 - own, sizes[t] - 1 - other
        at_pair = np.stack([other - own, other_back - own, other - own_back, other_back - own_back])
        for c, ((s, t), (sets, row)) in enumerate(twos.items()):
            if len(mine := np.flatnonzero(pair == s * scan + t)):
                each[:, 2 * scan + 4 * c : 2 * scan + 4 * c + 4] = self._sums(sets @ sizes, at_pair[:, mine], w[mine])[row]
        passed = self.passed[np.abs(x - y)[still]] @ v[still] + each @ turns
        scores = np.round(self.passed[n] - passed / total, 12).T.ravel()
        k = int(np.argmax(scores))
        if scores[k] <= 0:
            return 0.0, order, sign
        moved = [inside[c] for c in listed[k % len(listed)]]
        return float(scores[k]), [*order[:at], *moved, *order[at + scan :]], {**sign, **dict(zip(inside, signs[k // len(listed)].tolist(), strict=True))}


def _search(group: _Group, first: int, scan: int, both_ways: bool) -> tuple[list[int], dict[int, int], float]:
    n = len(group.sizes)
    first = min(first, MOST_SCAFFOLDS, n)
    scan = min(scan, first)
    score, order, sign = group.best(orders(first), [dict(enumerate(s)) for s in orientations(first)])
    order, sign = list(order), dict(sign)
    queue = list(range(first, n)) or [order.pop()]
    for new in queue:  # with nothing left, the last scaffold is taken out and placed again
        score, order, sign[new] = group.insert(order, sign, new)
    if n > first:
        better, turn, tried = True, 0, {}
        while better:
            better = False
            for at in range(n - scan + 1):
                if tried.get(at) == turn:  # nothing has changed since
                    continue
                tried[at] = turn
                got = group.window(order, sign, at, scan, both_ways)
                if got[0] > score + 1e-12:
                    (score, order, sign), better, turn = got, True, turn + 1
    return order, sign, score


def order_groups(assigned: DataFrame, cells: DataFrame, first: int = 6, scan: int = 5, both_ways: bool = False) -> DataFrame:
    """``map_id``, ``group_id``, ``ord`` from 1, ``scaffold``, ``orientation``, ``score``.

    The ``first`` largest scaffolds are tried in every order and orientation, the others are placed one by one, and windows of ``scan`` scaffolds are permuted
    until no window gets better. Ties: the first candidate of the enumeration. A group without contacts keeps its order, all plus.
    """
    bins = group_scaffolds(assigned).select("map_id", "group_id", "scaffold", "place", F.posexplode("bin_ids").alias("k", "bin_id"))
    at = lambda c: assigned.select(F.col("bin_id").alias(c), F.col("group_id").alias(f"g_{c}"))
    n = assigned.count()
    own = join_dictionary(join_dictionary(cells.where("i <> j"), at("i"), "i", rows=n, hot=False), at("j"), "j", rows=n, hot=False).where("g_i = g_j").select("map_id", F.col("g_i").alias("group_id"), "i", "j", "v")

    def run(members: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if not len(members):
            return pd.DataFrame({c: [] for c in ("map_id", "group_id", "ord", "scaffold", "orientation", "score")})
        members = members.sort_values(["place", "k"], ignore_index=True)
        scaffold = members["place"].to_numpy(np.int64) - 1
        index = pd.Series(np.arange(len(members)), members["bin_id"])
        names = members.drop_duplicates("place")["scaffold"].tolist()
        group = _Group(np.bincount(scaffold), scaffold, members["k"].to_numpy(np.int64), index[edges["i"]].to_numpy(), index[edges["j"]].to_numpy(), edges["v"].to_numpy())
        order, sign, score = _search(group, first, scan, both_ways)
        return pd.DataFrame({"map_id": members["map_id"].iloc[0], "group_id": members["group_id"].iloc[0], "ord": range(1, len(order) + 1), "scaffold": [names[s] for s in order], "orientation": ["-" if sign.get(s) else "+" for s in order], "score": score})

    keys = ["map_id", "group_id"]
    return spread(bins, *keys).cogroup(spread(own, *keys)).applyInPandas(run, "map_id int, group_id bigint, ord int, scaffold string, orientation string, score double")
