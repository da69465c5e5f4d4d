"""Registered queries of the operators in this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bintangle.llm import clusters, cooccurrence, encode, packing, quantiles, truncation
from bintangle.session import load, name_key, scaffold_names

PERCENTS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
#: A found pair: shared baskets at least, baskets of all for each shared one at most, times chance at least.
PAIR_MIN, PAIR_SPAN, PAIR_LIFT = 5, 200_000, 10


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_members(load(spark, sf_dir, "bins"), load(spark, sf_dir, "contacts"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.member_pairs(_members(spark, sf_dir))


def p1_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group with its size and its most typical bins."""
    return clusters.describe_clusters(_members(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = scaffold_names(load(spark, sf_dir, "scaffold_sizes"))
    sites = load(spark, sf_dir, "cut_sites").select(name_key(F.col("scaffold")).alias("key")).distinct()
    items = names.join(sites, "key", "left_semi").select("key", F.col("scaffold").alias("name"))
    rows = load(spark, sf_dir, "valid_pairs").select(F.col("read").alias("basket"), name_key(F.col("s1")).alias("key1"), name_key(F.col("s2")).alias("key2"))
    return cooccurrence.pair_statistics(rows, items)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    often = (F.col("n_ab") >= PAIR_MIN) & (whole("n_ab") * PAIR_SPAN >= whole("n_all")) & (whole("n_ab") * whole("n_all") >= whole("n_a") * whole("n_b") * PAIR_LIFT)
    return _pairs(spark, sf_dir).where(often).select(F.col("name1").alias("scaffold1"), F.col("name2").alias("scaffold2"))


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of scaffolds that shares a read, with its counts, lift and log odds ratio."""
    return _pairs(spark, sf_dir).select(F.col("name1").alias("scaffold1"), F.col("name2").alias("scaffold2"), "n_ab", "n_a", "n_b", "n_all", F.round("lift", 6).alias("lift"), F.round("log_odds", 6).alias("log_odds"))


def _contacts_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "contacts").select("map_id", F.to_date("loaded_at").alias("day"), "b1", "v")


def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each map, from sketches of its days combined."""
    days = quantiles.merge_sketches(quantiles.build_sketches(_contacts_by_day(spark, sf_dir), ["map_id", "day"], "v"), ["map_id", "day"])
    return quantiles.percentiles(quantiles.merge_sketches(days, ["map_id"]), ["map_id"], PERCENTS)


def p5_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of each map and day of loading."""
    days = quantiles.merge_sketches(quantiles.build_sketches(_contacts_by_day(spark, sf_dir), ["map_id", "day"], "v"), ["map_id", "day"])
    return quantiles.percentiles(days, ["map_id", "day"], [0.5])


def p5_scaffolds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of each scaffold, over the contacts of its bins as ``b1``."""
    bins = load(spark, sf_dir, "bins").select(F.col("bin_id").alias("b1"), name_key(F.col("scaffold")).alias("scaffold"))
    rows = load(spark, sf_dir, "contacts").select("b1", "v").join(bins, "b1")
    sketches = quantiles.build_sketches(rows, ["scaffold"], "v")
    return quantiles.percentiles(quantiles.merge_sketches(sketches, ["scaffold"]), ["scaffold"], PERCENTS)


def p5_within_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each map and percentile, whether the true rank of the reported value lies within the reported error, counted over all rows."""
    said = p5_percentiles(spark, sf_dir).withColumnRenamed("map_id", "m")
    rows = load(spark, sf_dir, "contacts").where("v IS NOT NULL AND NOT isnan(v)").select("map_id", "v")
    counted = rows.join(said, F.col("map_id").eqNullSafe(F.col("m"))).groupBy("map_id", "q").agg(
        F.max("n").alias("n"), F.max("rank_error").alias("e"), F.count_if(F.col("v") < F.col("value")).alias("below"), F.count_if(F.col("v") <= F.col("value")).alias("up_to")
    )
    within = (F.col("below") <= F.col("q") * F.col("n") + F.col("e")) & (F.col("up_to") >= F.col("q") * F.col("n") - F.col("e"))
    return counted.select("map_id", "q", "n", within.alias("within"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_column(load(spark, sf_dir, "documents").select("doc_id", "text"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text decoded from its ids again, as a digest."""
    return encode.decode_column(p6_ids(spark, sf_dir)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = p6_ids(spark, sf_dir).select("doc_id", F.size("ids").alias("n_tokens"))
    return packing.pack(tokens, "n_tokens")


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each text or part of a text."""
    return _packed(spark, sf_dir)


def p7_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, their items and tokens, and the share of their space that is used."""
    loads = packing.container_loads(_packed(spark, sf_dir))
    return loads.agg(F.count("*").alias("n_containers"), F.sum("n_items").alias("n_items"), F.sum("load").alias("n_tokens"), F.max("load").alias("fullest"), F.round(F.sum("load") / F.count("*") / packing.CAPACITY, 4).alias("used"))


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with tokens, texts that are in containers, containers that hold too much, and texts that are split although they fit one."""
    packed = _packed(spark, sf_dir)
    parts = packed.where("container IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("n_tokens").alias("n_tokens"), F.sum("part_size").alias("held"))
    texts = packed.select("doc_id", "n_tokens").distinct().agg(F.count_if(F.col("n_tokens") > 0).alias("n_texts"))
    placed = parts.agg(F.count_if(F.col("held") == F.col("n_tokens")).alias("n_placed"), F.count_if((F.col("n") > 1) & (F.col("n_tokens") <= packing.CAPACITY)).alias("n_split"))
    over = packing.container_loads(packed).agg(F.count_if(F.col("load") > packing.CAPACITY).alias("n_over"))
    return texts.join(F.broadcast(placed)).join(F.broadcast(over)).select("n_texts", "n_placed", "n_over", "n_split")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.find_truncated(load(spark, sf_dir, "documents")).where("cut IS NOT NULL").select("doc_id")


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, cut texts and their share, by source."""
    return truncation.by_source(truncation.find_truncated(load(spark, sf_dir, "documents")))


def p8_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cut texts were found by, with the share of each."""
    return truncation.by_reason(truncation.find_truncated(load(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (p1_found, p1_clusters, p2_found, p2_pairs, p5_percentiles, p5_daily, p5_scaffolds, p5_within_bound, p6_ids, p6_decoded, p7_packed, p7_use, p7_checked, p8_found, p8_sources, p8_reasons)}

_PAIRS = r"""
WITH names AS (SELECT lower(regexp_replace(scaffold, '^[\s\x{0B}\x{A0}]+|[\s\x{0B}\x{A0}]+$', '', 'g')) AS key, min(scaffold) AS scaffold FROM scaffold_sizes WHERE scaffold IS NOT NULL GROUP BY 1),
sites AS (SELECT DISTINCT lower(regexp_replace(scaffold, '^[\s\x{0B}\x{A0}]+|[\s\x{0B}\x{A0}]+$', '', 'g')) AS key FROM cut_sites),
items AS (SELECT key, scaffold FROM names SEMI JOIN sites USING (key)),
sides AS (SELECT read, s1 AS s FROM valid_pairs UNION ALL SELECT read, s2 FROM valid_pairs),
held AS (SELECT DISTINCT read, scaffold FROM (SELECT read, lower(regexp_replace(s, '^[\s\x{0B}\x{A0}]+|[\s\x{0B}\x{A0}]+$', '', 'g')) AS key FROM sides WHERE read IS NOT NULL) JOIN items USING (key)),
every AS (SELECT count(DISTINCT read) AS n_all FROM held),
single AS (SELECT scaffold, count(*) AS n FROM held GROUP BY 1),
shared AS (SELECT a.scaffold AS scaffold1, b.scaffold AS scaffold2, count(*) AS n_ab FROM held a JOIN held b ON a.read = b.read AND a.scaffold < b.scaffold GROUP BY ALL),
pairs AS (SELECT scaffold1, scaffold2, n_ab, x.n AS n_a, y.n AS n_b, n_all FROM shared JOIN single x ON x.scaffold = scaffold1 JOIN single y ON y.scaffold = scaffold2, every)
"""
SQL = {
    "p2_found": _PAIRS + "SELECT scaffold1, scaffold2 FROM pairs WHERE n_ab >= 5 AND n_ab * 200000 >= n_all AND n_ab::HUGEINT * n_all >= 10 * n_a::HUGEINT * n_b",
    "p2_pairs": _PAIRS
    + """SELECT scaffold1, scaffold2, n_ab, n_a, n_b, n_all, round(n_ab::DOUBLE * n_all / (n_a::DOUBLE * n_b), 6) AS lift,
round(ln((n_ab + 0.5::DOUBLE) * (n_all - n_a - n_b + n_ab + 0.5::DOUBLE) / ((n_a - n_ab + 0.5::DOUBLE) * (n_b - n_ab + 0.5::DOUBLE))), 6) AS log_odds FROM pairs""",
    "p6_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p7_checked": "SELECT count(*) AS n_texts, count(*) AS n_placed, 0::BIGINT AS n_over, 0::BIGINT AS n_split FROM documents WHERE text <> ''",
    "p5_within_bound": """SELECT map_id, q, n, true AS within FROM (SELECT map_id, count(*) AS n FROM contacts WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY 1),
(SELECT unnest([0.01::DOUBLE, 0.05::DOUBLE, 0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS q)""",
}
