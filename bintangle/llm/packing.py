"""Filling fixed-capacity containers with items by harmonic packing.

An item of size s belongs to the reciprocal class m = floor(capacity / s): any m items of class m fit one container. Workers are bounded shares of the items; each fills its
containers alone, class by class, m items to a container:

1. classes up to ``LARGE`` are filled first, m items each. Such a container keeps up to 1 / (m + 1) free, which takes the largest items of smaller classes that still fit;
2. what is left of each class fills containers of m items;
3. the items of containers that stay short of m are handed to the next round, where ``FAN`` workers become one, until one worker is left; only that one closes short containers, best fit.

Items larger than a container are split: each full part has a container of its own, and the rest is packed like any item. No other item is split.

Defined cases: items of null, zero or negative size take no space and have a null container; null and repeated ids are items of their own; empty tables give no rows; other columns pass through unless their
names are ``part``, ``part_size`` or ``container``, which are replaced.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bintangle.session import durable

CAPACITY = 4096
#: Items of one worker, about; bounds what one task holds.
SHARE = 20_000
#: Workers that become one in the next round.
FAN = 32
#: Classes whose containers are topped up with smaller items.
LARGE = 3


def _fill(group: pd.DataFrame, capacity: int, last: bool) -> pd.DataFrame:
    """One worker: ``bin`` of each item, -1 for those handed on."""
    size = group["part_size"].to_numpy()
    order = np.lexsort((group["_item"].to_numpy(), -size))
    size = size[order]
    kind = capacity // size
    place = np.full(len(size), -1, np.int64)
    bins, short = 0, []
    small = [int(x) for x in np.flatnonzero(kind > 1)[::-1]]  # ascending sizes
    sizes = [int(size[k]) for k in small]
    for m in range(1, LARGE + 1):
        if m == 1:
            own = np.flatnonzero(kind == 1)
        else:  # what the greater classes left of this one
            at = bisect_right(sizes, capacity // (m + 1))
            own = np.array(small[at:][::-1], np.int64)
            del small[at:], sizes[at:]
        for k in range(0, len(own), m):
            chosen = own[k : k + m]
            free = capacity - int(size[chosen].sum())
            if len(chosen) < m and not last:
                short.extend(chosen)
                continue
            place[chosen] = bins
            while (at := bisect_right(sizes, free)) > 0:
                place[small.pop(at - 1)] = bins
                free -= sizes.pop(at - 1)
            bins += 1
    rest = np.array(small[::-1], np.int64)
    for m in np.unique(kind[rest]) if len(rest) else []:
        own = rest[kind[rest] == m]
        full = len(own) // m * m
        place[own[:full]] = bins + np.arange(full) // m
        bins += full // m
        short.extend(own[full:])
    if last:
        room: list[tuple[int, int]] = []
        for k in sorted(short, key=lambda k: -size[k]):
            if place[k] >= 0:
                continue
            at = bisect_right(room, (int(size[k]), -1))
            free, b = room.pop(at) if at < len(room) else (capacity, bins)
            bins += b == bins
            place[k] = b
            insort(room, (free - int(size[k]), b))
    return pd.DataFrame({"_item": group["_item"].to_numpy()[order], "part_size": size, "_worker": group["_worker"].to_numpy()[order], "_bin": place})


def _filler(capacity: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def fill(group: pd.DataFrame) -> pd.DataFrame:
        return _fill(group, capacity, last)

    return fill


def pack(items: DataFrame, size: str, capacity: int = CAPACITY, share: int = SHARE) -> DataFrame:
    """``items`` with ``part``, ``part_size`` and ``container``; a row for each part of a split item."""
    spark = items.sparkSession
    keep = [c for c in items.columns if c not in {"part", "part_size", "container"}]
    rows = durable(items.select(*keep, F.monotonically_increasing_id().alias("_row"), F.col(size).cast("bigint").alias("_size")))
    full = F.when(F.col("_size") > capacity, F.expr(f"_size div {capacity}")).otherwise(F.lit(0))
    parts = rows.withColumn("_full", full).withColumn("part", F.explode(F.when(F.col("_size") > 0, F.sequence(F.lit(0), F.expr(f"int(_full - if(_size > {capacity} AND _size % {capacity} = 0, 1, 0))"))).otherwise(F.array(F.lit(0)))))
    parts = parts.withColumn("part_size", F.when(F.col("_size") > 0, F.when(F.col("part") < F.col("_full"), F.lit(capacity)).otherwise(F.col("_size") - F.col("_full") * capacity)).otherwise(F.lit(0)).cast("bigint"))
    split = F.col("part") < F.col("_full")
    alone = parts.where((F.col("_size") > 0) & split).select("_row", "part", "part_size", F.concat_ws(":", F.lit("split"), "_row", "part").alias("container"))
    free = parts.where("_size IS NULL OR _size <= 0").select("_row", "part", "part_size", F.lit(None).cast("string").alias("container"))
    whole = parts.where((F.col("_size") > 0) & ~split).select("_row", "part", "part_size")
    workers = max(1, -(-whole.count() // share))
    open_items = whole.select(F.col("_row").alias("_item"), "part_size", F.pmod(F.xxhash64("_row"), F.lit(workers)).cast("bigint").alias("_worker"))
    placed, turn = [], 0
    while True:
        last = workers == 1
        filled = durable(open_items.groupBy("_worker").applyInPandas(_filler(capacity, last), "_item bigint, part_size bigint, _worker bigint, _bin bigint"))
        placed.append(filled.where("_bin >= 0").select(F.col("_item").alias("_row"), F.concat_ws(":", F.lit(str(turn)), "_worker", "_bin").alias("container")))
        if last:
            break
        open_items = filled.where("_bin < 0").select("_item", "part_size", F.expr(f"_worker div {FAN}").alias("_worker"))
        workers, turn = -(-workers // FAN), turn + 1
    together = placed[0]
    for more in placed[1:]:
        together = together.union(more)
    packed = whole.join(together, "_row").union(alone).union(free)
    return rows.join(packed, "_row").select(*keep, "part", "part_size", "container")


def container_loads(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``container``, ``n_items``, ``load`` and the ``unused`` space of each container."""
    return packed.where("container IS NOT NULL").groupBy("container").agg(F.count("*").alias("n_items"), F.sum("part_size").alias("load")).withColumn("unused", F.lit(capacity) - F.col("load"))
