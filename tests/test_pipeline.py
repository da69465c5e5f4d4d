"""The parts fed with one another's rows, over several maps whose groups have the same numbers."""

from __future__ import annotations

import inspect
import os

from pyspark.sql import functions as F

from bintangle.operators import graph, order
from bintangle.plans import assembly, pipeline
from bintangle.plans.config import Config
from bintangle.plans.pipeline import find_groups, join_sequences, mark_small, order_scaffolds, orient_scaffolds
from tests.test_operators import planted_frames

ORDER = "map_id int, group_id long, ord int, scaffold string, orientation string"


def two_maps(spark):
    sizes = spark.createDataFrame([("A", 1000), ("m", 100), ("B", 1000), ("x", 150), ("u", None)], "scaffold string, size long")
    rows = [(1, 1, 1, "A", "+"), (1, 1, 2, "m", "+"), (1, 1, 3, "B", "+"), (2, 1, 1, "B", "+"), (2, 1, 2, "m", "+"), (2, 1, 3, "x", "-"), (2, 1, 4, "A", "+"), (2, 1, 5, "u", "-")]
    sites = sizes.select("scaffold", F.array().cast("array<bigint>").alias("coords"))
    pairs = spark.createDataFrame([("m", 50, "A", 950)] * 3 + [("m", 5, "B", 10)] * 2 + [("x", 60, "A", 150)] * 2, "s1 string, p1 long, s2 string, p2 long")
    return sizes, spark.createDataFrame(rows, ORDER), sites, pairs


def test_orientation_of_one_map_does_not_depend_on_another(spark):
    sizes, ordered, sites, pairs = two_maps(spark)
    widths = spark.createDataFrame([(1, 100), (2, 200)], "map_id int, resolution long")
    config = Config(length_cutoff=100)
    assert {(r.map_id, r.scaffold) for r in mark_small(ordered, sizes, config, widths).where("is_small").collect()} == {(1, "m"), (2, "m"), (2, "x")}
    got = {(r.map_id, r.group_id, r.ord, r.scaffold, r.orientation) for r in orient_scaffolds(ordered, sizes, sites, pairs, config, widths).collect()}
    # map 1: m has more links to the end of A on its left; map 2: more to B on its left than to x; x has all links within 200, not within 100, of the start of A
    assert got == {(1, 1, 1, "A", "+"), (1, 1, 2, "m", "-"), (1, 1, 3, "B", "+"), (2, 1, 1, "B", "+"), (2, 1, 2, "m", "+"), (2, 1, 3, "x", "+"), (2, 1, 4, "A", "+"), (2, 1, 5, "u", "-")}
    for one in (1, 2):
        alone = orient_scaffolds(ordered.where(F.col("map_id") == one), sizes, sites, pairs, config, widths).collect()
        assert {(r.map_id, r.group_id, r.ord, r.scaffold, r.orientation) for r in alone} == {x for x in got if x[0] == one}


def test_joined_sequences_of_each_map(spark):
    seqs = spark.createDataFrame([("a", "AC", 1), ("b", "GG", 2), ("c", "T", 3)], "name string, seq string, ord int")
    ordered = spark.createDataFrame([(1, 1, 1, "a", "-"), (2, 1, 1, "b", "+"), (2, 1, 2, "a", "+"), (2, 2, 1, "c", "-")], ORDER)
    whole = {}
    for r in join_sequences(ordered, seqs).orderBy("map_id", "name", "line_no").collect():
        whole[r.map_id, r.name] = whole.get((r.map_id, r.name), "") + r.line
    assert whole == {(1, "Chr_1"): "GT", (1, "b"): "GG", (1, "c"): "T", (2, "Chr_1"): "GG" + "N" * 100 + "AC", (2, "Chr_2"): "A"}


def test_all_parts_over_two_maps(spark):
    bins, cells, _, _ = planted_frames(spark)
    bins = bins.unionByName(bins.withColumns({"map_id": F.lit(2), "bin_id": F.col("bin_id") + 1000}))
    cells = cells.unionByName(cells.withColumns({"map_id": F.lit(2), "i": F.col("i") + 1000, "j": F.col("j") + 1000}))
    sizes = spark.createDataFrame([(f"s{k:02d}", 50 + k if k else None) for k in range(11)], "scaffold string, size long")  # s00 is null, s11 missing
    config = Config(resolution=50, modularity=1.0, restarts=2, first_scaffolds=3, scan_scaffolds=3)
    groups = find_groups(bins, cells, sizes, config)
    assert groups.count() == 120 and {(r.scaffold, r.map_id) for r in groups.where("NOT sized").collect()} == {("s00", 1), ("s00", 2), ("s11", 1), ("s11", 2)}
    ordered = order_scaffolds(groups, cells, config)
    sites = sizes.select("scaffold", F.array().cast("array<bigint>").alias("coords"))
    pairs = spark.createDataFrame([], "s1 string, p1 long, s2 string, p2 long")
    got = orient_scaffolds(ordered, sizes, sites, pairs, config)
    rows = [tuple(r) for r in got.select("map_id", "group_id", "ord", "scaffold").collect()]
    assert sorted(rows) == sorted(map(tuple, ordered.select("map_id", "group_id", "ord", "scaffold").collect())) and len(set(rows)) == 24
    seqs = bins.select(F.col("scaffold").alias("name"), F.lit("ACGT").alias("seq"), F.lit(1).alias("ord")).distinct()
    assert {(r.map_id, r.name) for r in join_sequences(got, seqs).collect()} == {(m, f"Chr_{g}") for m in (1, 2) for g in (1, 2, 3)}


def test_registered_queries_search_in_full(spark, monkeypatch):
    sf, seen = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"), {}

    def record(module, name):
        real = getattr(module, name)

        def call(*args, **kw):
            bound = inspect.signature(real).bind(*args, **kw)
            bound.apply_defaults()
            seen.setdefault(name, []).append(bound.arguments)
            return real(*args, **kw)

        monkeypatch.setattr(module, name, call)

    for module, name in ((graph, "communities"), (order, "order_groups"), (pipeline, "find_groups")):
        record(module, name)
    for query in ("graph2_communities", "graph4_tail", "order7_search", "pipe1_groups"):
        groups = assembly.QUERIES[query](spark, sf)
    default = Config()
    assert len(seen["communities"]) == 3 and {x["restarts"] for x in seen["communities"]} == {default.restarts}
    assert [(x["first"], x["scan"]) for x in seen["order_groups"]] == [(default.first_scaffolds, default.scan_scaffolds)]
    assert seen["find_groups"][0]["bins"].count() == assembly.QUERIES["scan1_bins"](spark, sf).count() and "sized" in groups.columns
