"""Times of plain single-process loops over the same tables, to compare with the Spark queries of the same names: ``python naive.py [DIR]`` prints one JSON line."""

from __future__ import annotations

import json
import math
import sys
import time
from collections import Counter, defaultdict
from itertools import combinations

import pandas as pd


def table(folder: str, name: str, columns: list[str]) -> list[tuple]:
    return list(pd.read_parquet(f"{folder}/{name}.parquet", columns=columns).astype(object).itertuples(index=False, name=None))


def key(name: str | None) -> str | None:
    return None if not isinstance(name, str) else name.strip().lower()


def contacts(folder: str) -> dict[int, dict[int, dict[int, float]]]:
    """Map to row to column to value: both directions of the latest value of each pair of known bins."""
    bias = {n: t for n, t in table(folder, "biases", ["line_no", "bias_txt"])}
    of_map = {b: m for n, b, m in table(folder, "bins", ["line_no", "bin_id", "map_id"]) if bias.get(n) != "nan"}
    latest: dict[tuple, tuple] = {}
    for b1, b2, v, at in table(folder, "contacts", ["b1", "b2", "v", "loaded_at"]):
        if b1 is None or b2 is None or b1 != b1 or b2 != b2:
            continue
        pair = (min(b1, b2), max(b1, b2))
        v = v if v is not None and v == v else -math.inf
        if pair not in latest or (at, v) > latest[pair]:
            latest[pair] = (at, v)
    maps: dict[int, dict[int, dict[int, float]]] = defaultdict(lambda: defaultdict(dict))
    for (i, j), (_, v) in latest.items():
        if 0 < v < math.inf and i in of_map and of_map.get(j) == of_map[i]:
            maps[of_map[i]][i][j] = maps[of_map[i]][j][i] = v
    return maps


def distances(maps: dict) -> int:
    n = 0
    for rows in maps.values():
        for row in rows.values():
            total = sum(row.values())
            n += len([2 - v / total for v in row.values()])
    return n


def ranks(maps: dict) -> dict[int, list[list[int]]]:
    """Of each map, the columns of each row by falling value, zeros by falling column behind."""
    out = {}
    for m, rows in maps.items():
        place = {b: k for k, b in enumerate(sorted(rows))}
        n, out[m] = len(place), []
        for b in sorted(rows):
            dense = [0.0] * n
            for j, v in rows[b].items():
                dense[place[j]] = v
            out[m].append(sorted(range(n), key=lambda k: (-dense[k], -k)))
    return out


def tails(ranked: dict[int, list[list[int]]]) -> int:
    count = 0
    for rows in ranked.values():
        n = len(rows)
        for i in range(1, n):
            x = sum(1 for k in range(i) if rows[i][k] <= i)
            base = math.lgamma(i + 1) + math.lgamma(n - i + 1) - math.lgamma(n + 1) + math.lgamma(i + 1) + math.lgamma(n - i + 1)
            p = 1.0
            if x > max(0, 2 * i - n):
                p = sum(math.exp(base - math.lgamma(k + 1) - 2 * math.lgamma(i - k + 1) - math.lgamma(n - 2 * i + k + 1)) for k in range(x, i + 1))
            count += p < 0.05
    return count


def scores(maps: dict, stride: int = 40) -> float:
    """The order score of every ``stride`` bins by sums of the diagonals of a dense matrix."""
    best = 0.0
    for rows in maps.values():
        bins = sorted(rows)
        for at in range(0, len(bins), stride):
            own = bins[at : at + stride]
            total = sum(rows[a].get(b, 0.0) for a, b in combinations(own, 2))
            running = cost = 0.0
            for d in range(1, len(own)):
                for k in range(len(own) - d):
                    running += rows[own[k]].get(own[k + d], 0.0)
                cost += running / total / d if total else 0.0
            best = max(best, cost)
    return best


def modularity(folder: str, maps: dict) -> list[float]:
    scaffold = {b: key(s) for b, s in table(folder, "bins", ["bin_id", "scaffold"])}
    out = []
    for rows in maps.values():
        total, inside, degree = 0.0, Counter(), Counter()
        for i, row in rows.items():
            for j, v in row.items():
                if i <= j:
                    total += v
                    degree[scaffold[i]] += v
                    degree[scaffold[j]] += v
                    inside[scaffold[i]] += v * (scaffold[i] == scaffold[j])
        out.append(sum(inside[c] / total - (d / (2 * total)) ** 2 for c, d in degree.items()))
    return out


def pairs(folder: str) -> int:
    names = {key(s) for (s,) in table(folder, "scaffold_sizes", ["scaffold"])} & {key(s) for (s,) in table(folder, "cut_sites", ["scaffold"])}
    baskets = defaultdict(set)
    for read, s1, s2 in table(folder, "valid_pairs", ["read", "s1", "s2"]):
        if isinstance(read, str):
            baskets[read].update({key(s1), key(s2)} & names)
    return len(Counter(p for items in baskets.values() for p in combinations(sorted(items), 2)))


def hot(folder: str) -> int:
    rows, low, high = Counter(), {}, {}
    for s, p in table(folder, "valid_pairs", ["s1", "p1"]):
        k = key(s)
        rows[k] += 1
        if p is not None and p == p:
            low[k], high[k] = min(p, low.get(k, p)), max(p, high.get(k, p))
    return len(rows)


def percentiles(folder: str) -> int:
    values = defaultdict(list)
    for m, v in table(folder, "contacts", ["map_id", "v"]):
        if v is not None and v == v:
            values[m].append(v)
    return sum(len([sorted(x)[int(q * (len(x) - 1))] for q in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)]) for x in values.values())


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    times: dict[str, float] = {}

    def timed(name: str, before: float, f, *args):
        start = time.perf_counter()
        found = f(*args)
        times[name] = round(before + time.perf_counter() - start, 2)
        return found

    maps = timed("scan2_contacts", 0.0, contacts, folder)
    read = times["scan2_contacts"]
    timed("proj1_distance", read, distances, maps)
    ranked = timed("sort1_ranks", read, ranks, maps)
    timed("agg8_tail", times["sort1_ranks"], tails, ranked)
    timed("order10_score", read, scores, maps)
    timed("graph3_modularity", read, modularity, folder, maps)
    timed("p2_found", 0.0, pairs, folder)
    timed("p4_found", 0.0, hot, folder)
    timed("p5_percentiles", 0.0, percentiles, folder)
    print(json.dumps({"seconds": times, "dir": folder}))


if __name__ == "__main__":
    main()
