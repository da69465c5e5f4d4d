"""Similarity clusters by grid density: groups of bins that contact one another.

The contact map of ``map_id`` is the grid: a pair of bins is a cell. The features are quantised, the points of the cells counted, adjacent
dense cells joined, and the least label propagated along them until nothing changes:

1. the latest value of each unordered pair holds; values are quantised in powers of two of the map's geometric mean,
   and a cell is occupied from ``least_level`` on, and strongly occupied from the next level on;
2. a cell's count is the number of other bins whose contacts with both its bins are occupied. Its density is that count as a share of all other
   bins in occupied contact with either; stray contacts, however strong, share no neighbours. Among strongly occupied cells it is counted again, and the greater density holds;
3. a cell of at least ``least_density`` is dense; dense cells that share a bin are adjacent;
4. each bin takes the least label among the bins of its dense cells, with pointer jumping, and bins of one label become one, until no label changes;
5. clusters of at least ``least_members`` bins are reported with the members that lie in the densest cells.

Steps 1 and 3 to 5 are SQL. Common neighbours (step 2) are counted in blocks of ``BLOCK`` bins: a task takes the cells of two blocks of a map and their
cells with a third, packs these to words and counts the common bits of each cell; counts of the third blocks are added up. A block holds a bounded
number of bins, so no map, however many rows it has, is one task. Copies of a cell grow with the blocks of its map; maps of more than ``MOST_BLOCKS`` blocks are counted by
SQL as triangles over edges that point from the bin with fewer contacts to the one with more, where no bin has more than sqrt(2 cells)
outgoing edges. Both ways give the same counts.

Defined cases: null, NaN, infinite, zero and negative values, contacts of a bin with itself, and contacts with bins that are unknown, null or
of another map make no cell; of rows equal in ``loaded_at`` the greatest usable value holds; a repeated ``bin_id`` keeps its least ``map_id``;
bins without dense cells belong to no cluster, and two bins that only touch each other make none; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bintangle.session import durable, join_dictionary, number_rows, release

#: Least quantised value of an occupied cell: 2**-1, half of the map's geometric mean.
LEAST_LEVEL = -1
#: Least share of common neighbours that makes a cell dense.
LEAST_DENSITY = 0.2
#: Fewest bins of a cluster.
LEAST_MEMBERS = 3
#: Members named in a cluster's description.
TYPICAL = 3
#: Bins of a block: two adjacency blocks of packed words take 1 MB.
BLOCK = 2048
#: Blocks of the largest map that is counted in blocks.
MOST_BLOCKS = 8


def occupied_cells(bins: DataFrame, contacts: DataFrame, least_level: int = LEAST_LEVEL) -> DataFrame:
    """``map_id``, ``i`` < ``j``, ``level`` of each occupied cell."""
    spark = bins.sparkSession
    known = durable(spark.sql("SELECT bin_id, min(map_id) AS map_id FROM {bins} WHERE bin_id IS NOT NULL AND map_id IS NOT NULL GROUP BY bin_id", bins=bins))
    latest = spark.sql(
        """
        SELECT least(b1, b2) AS i, greatest(b1, b2) AS j, max(struct(loaded_at, CASE WHEN NOT isnan(v) THEN v END AS v)).v AS v
        FROM {contacts} WHERE b1 <> b2 GROUP BY 1, 2
        """,
        contacts=contacts,
    ).where("v > 0 AND v < double('Infinity')")
    n_bins = known.count()
    one = join_dictionary(latest, known.select(F.col("bin_id").alias("i"), "map_id"), "i", rows=n_bins, hot=False)
    both = join_dictionary(one, known.select(F.col("bin_id").alias("j"), F.col("map_id").alias("_map")), "j", rows=n_bins, hot=False).where("map_id = _map")
    cells = durable(both.select("map_id", "i", "j", F.ln("v").alias("ln_v")))
    release(known)
    scale = cells.groupBy("map_id").agg(F.avg("ln_v").alias("mean_ln"))
    levels = join_dictionary(cells, scale, "map_id").select("map_id", "i", "j", F.floor((F.col("ln_v") - F.col("mean_ln")) / F.log(F.lit(2.0))).cast("int").alias("level"))
    return levels.where(F.col("level") >= least_level)


def _packed_counts(group: pa.Table) -> pa.Table:
    """Common neighbours, in block c, of the cells between blocks a and b of one map; places are counted within a block."""
    a, b, c = (group.column(k)[0].as_py() for k in "abc")
    p, q, x, y = (group.column(k).to_numpy() for k in ("p", "q", "x", "y"))
    strong = group.column("strong").to_numpy(zero_copy_only=False)

    def words(block: int, live: np.ndarray) -> np.ndarray:
        bits = np.zeros((BLOCK, BLOCK), bool)
        one, two = live & (p == block) & (q == c), live & (q == block) & (p == c)
        bits[x[one], y[one]] = True
        bits[y[two], x[two]] = True
        return np.packbits(bits, axis=1).view(np.uint64)

    own = np.flatnonzero((p == a) & (q == b))
    x_own, y_own, n = x[own], y[own], []
    for live in (np.ones(len(p), bool), strong):
        of_a = words(a, live)
        of_b = of_a if a == b else words(b, live)
        parts = [np.bitwise_count(of_a[x_own[k : k + BLOCK]] & of_b[y_own[k : k + BLOCK]]).sum(1, dtype=np.int64) for k in range(0, len(own), BLOCK)]
        n.append(np.concatenate(parts) if parts else np.empty(0, np.int64))
    n[1] = np.where(strong[own], n[1], 0)
    some = np.flatnonzero(n[0])
    i, j = (group.column(k).to_numpy()[own[some]] for k in "ij")
    return pa.table({"i": pa.array(i, pa.int64()), "j": pa.array(j, pa.int64()), "n": pa.array(n[0][some], pa.int64()), "n_strong": pa.array(n[1][some], pa.int64())})


def _in_blocks(cells: DataFrame, places: DataFrame, rows: int) -> DataFrame:
    """``i``, ``j``, ``n``, ``n_strong``: common neighbours of each cell, counted in blocks. ``places``: ``bin``, ``block``, ``place``, ``n_blocks`` of its map; at most ``rows`` of them."""
    for end, block, place in (("i", "p", "x"), ("j", "q", "y")):
        cells = join_dictionary(cells, places.select(F.col("bin").alias(end), F.col("block").alias(block), F.col("place").alias(place), *(["n_blocks"] if end == "i" else [])), end, rows=rows, hot=False)
    # the cell lies between p and q: it is counted in every (p, q, c), and is a neighbour in block q of bins of p, and in block p of bins of q; p <= q, as places rise with the bin
    pair = lambda u, v, c: F.struct(F.least(u, v).alias("a"), F.greatest(u, v).alias("b"), c.alias("c"))
    other = F.sequence(F.lit(0), F.col("n_blocks") - 1)
    p, q = F.col("p"), F.col("q")
    triples = F.array_distinct(F.flatten(F.transform(other, lambda o: F.array(pair(p, q, o), pair(p, o, q), pair(q, o, p)))))
    sent = cells.select("map_id", "i", "j", "strong", "p", "q", "x", "y", F.explode(F.when(F.col("n_blocks") == 1, F.array(pair(p, q, p))).otherwise(triples)).alias("t")).select("*", "t.*").drop("t")
    counted = sent.groupBy("map_id", "a", "b", "c").applyInArrow(_packed_counts, "i bigint, j bigint, n bigint, n_strong bigint")
    return counted.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("n_strong").alias("n_strong"))


def _in_triangles(cells: DataFrame) -> DataFrame:
    """The same counts as triangles; each is found at its bin of fewest contacts."""
    return cells.sparkSession.sql(
        """
        WITH rising AS (SELECT if(up, i, j) AS low, if(up, j, i) AS high, strong FROM {cells}),
        wedges AS (
          SELECT a.low, least(a.high, b.high) AS i, greatest(a.high, b.high) AS j, a.strong AND b.strong AS strong
          FROM rising a JOIN rising b ON a.low = b.low AND a.high < b.high),
        triangles AS (SELECT low, w.i, w.j, w.strong AND c.strong AS strong FROM wedges w JOIN {cells} c ON w.i = c.i AND w.j = c.j),
        sides AS (SELECT explode(array(struct(i, j), struct(least(low, i) AS i, greatest(low, i) AS j), struct(least(low, j) AS i, greatest(low, j) AS j))) AS side, strong FROM triangles)
        SELECT side.i, side.j, count(*) AS n, count_if(strong) AS n_strong FROM sides GROUP BY 1, 2
        """,
        cells=cells,
    )


def dense_cells(cells: DataFrame, least_density: float = LEAST_DENSITY, strong_level: int = LEAST_LEVEL + 1, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``map_id``, ``i``, ``j``, ``density`` of each dense cell among ``cells`` (``map_id``, ``i``, ``j``, ``level``; bins lie in one map only)."""
    spark = cells.sparkSession
    marked = cells.select("map_id", "i", "j", (F.col("level") >= strong_level).alias("strong"))
    ends = marked.select("map_id", "strong", F.explode(F.array("i", "j")).alias("bin"))
    numbered = number_rows(ends.groupBy("map_id", "bin").agg(F.count("*").alias("d"), F.count_if("strong").alias("s")), "map_id", "bin")
    maps = numbered.groupBy("map_id").agg(F.min("number").alias("first"), F.max("number").alias("last"))
    at = F.col("number") - F.col("first")
    places = durable(join_dictionary(numbered, maps, "map_id").select("map_id", "bin", "d", "s", F.expr(f"int((number - first) div {BLOCK})").alias("block"), (at % BLOCK).cast("int").alias("place"), F.expr(f"int((last - first) div {BLOCK} + 1)").alias("n_blocks")))
    side = lambda end, *more: places.select(F.col("bin").alias(end), F.col("d").alias(f"d_{end}"), F.col("s").alias(f"s_{end}"), *more)
    n_bins, n_large = places.agg(F.count("*"), F.count_if(F.col("n_blocks") > most_blocks)).first()
    counts = _in_blocks(marked, places.where(F.col("n_blocks") <= most_blocks), n_bins)
    if n_large:
        wide = join_dictionary(join_dictionary(marked, side("i", "n_blocks"), "i", rows=n_bins, hot=False).where(F.col("n_blocks") > most_blocks), side("j"), "j", rows=n_bins, hot=False)
        counts = counts.unionByName(_in_triangles(durable(wide.select("i", "j", "strong", (F.struct("d_i", "i") < F.struct("d_j", "j")).alias("up")))))
    sized = join_dictionary(join_dictionary(counts, side("i", "map_id"), "i", rows=n_bins, hot=False), side("j"), "j", rows=n_bins, hot=False)
    density = F.greatest(F.col("n") / (F.col("d_i") + F.col("d_j") - 2 - F.col("n")), F.when(F.col("n_strong") > 0, F.col("n_strong") / (F.col("s_i") + F.col("s_j") - 2 - F.col("n_strong"))).otherwise(0.0))
    return sized.select("map_id", "i", "j", density.alias("density")).where(F.col("density") >= least_density)


def propagate_labels(edges: DataFrame) -> DataFrame:
    """``node``, ``label``: the least node each node of ``edges`` (``i``, ``j``) is connected with.

    In every round a node takes the least label beside it and follows that label to its own until nothing moves; then the nodes of one label are one node, and only
    edges between different labels remain. Rounds go on until no edge does. Labels and edges of each round are checkpointed, so a lost executor costs at most one round.
    """
    edges, found = durable(edges.select("i", "j").where("i <> j").distinct()), None
    while found is None or not edges.isEmpty():
        beside = edges.select(F.col("i").alias("node"), F.col("j").alias("other")).union(edges.select(F.col("j"), F.col("i")))
        labels, still = durable(beside.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label"))), False
        n = labels.count()
        while not still:
            jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
            far = join_dictionary(jump.withColumnRenamed("next", "over"), jump.select(F.col("label").alias("over"), "next"), "over", rows=n, hot=False).select("label", "next")
            moved = durable(join_dictionary(labels, far, "label", rows=n, hot=False).select("node", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved")))
            still = moved.where("moved").isEmpty()
            release(labels)
            labels = moved.drop("moved")
        ends = join_dictionary(join_dictionary(edges, labels.select(F.col("node").alias("i"), F.col("label").alias("a")), "i", rows=n, hot=False), labels.select(F.col("node").alias("j"), F.col("label").alias("b")), "j", rows=n, hot=False)
        fewer = durable(ends.where("a <> b").select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).distinct())
        release(edges)
        edges = fewer
        if found is None:
            found = labels
        else:
            onward = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
            joined = durable(join_dictionary(found, onward, "label", "left", rows=n, hot=False).select("node", F.coalesce("next", "label").alias("label")))
            release(found)
            release(labels)
            found = joined
    release(edges)
    return found


def cluster_members(bins: DataFrame, contacts: DataFrame, least_level: int = LEAST_LEVEL, least_density: float = LEAST_DENSITY, least_members: int = LEAST_MEMBERS) -> DataFrame:
    """``map_id``, ``cluster`` (its least bin), ``bin_id``, ``score`` (sum of the densities of the bin's dense cells)."""
    dense = durable(dense_cells(occupied_cells(bins, contacts, least_level), least_density, least_level + 1))
    labels = propagate_labels(dense)
    scores = dense.select("map_id", "density", F.explode(F.array("i", "j")).alias("node")).groupBy("node").agg(F.min("map_id").alias("map_id"), F.sum("density").alias("score"))
    members = join_dictionary(scores, labels, "node", hot=False)
    large = members.groupBy("label").count().where(F.col("count") >= least_members).select("label")
    found = durable(join_dictionary(members, large, "label").select("map_id", F.col("label").alias("cluster"), F.col("node").alias("bin_id"), "score"))
    release(dense)
    release(labels)
    return found


def describe_clusters(members: DataFrame, typical: int = TYPICAL) -> DataFrame:
    """``map_id``, ``cluster``, ``n_bins`` and its ``typical`` bins, those in the densest cells first; ties go to the lesser bin."""
    size = members.groupBy("map_id", "cluster").agg(F.count("*").alias("n_bins"))
    best = members.select("cluster", "bin_id", F.expr("row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, bin_id)").alias("place")).where(F.col("place") <= typical)
    named = best.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "bin_id"))), lambda x: x.bin_id).alias("typical"))
    return size.join(named, "cluster").select("map_id", "cluster", "n_bins", "typical")


def member_pairs(members: DataFrame) -> DataFrame:
    """``bin1`` < ``bin2``: every two bins of one cluster. A cluster lies in one map, so its pairs are bounded by the map's bins."""
    a, b = members.select("cluster", F.col("bin_id").alias("bin1")), members.select("cluster", F.col("bin_id").alias("bin2"))
    return a.join(b, "cluster").where("bin1 < bin2").select("bin1", "bin2")
