"""Registered queries of the assembly operators, and the SQL each is checked against.

They run over all maps of the given tables. Where an operator needs a grouping or an order that is not delivered, a plain one is derived from the tables, the same in Spark and in SQL:
groups of ``STRIDE`` consecutive bins, and sizes in name order, eight to a group, turned by the parity of their line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bintangle.functions.special import wrap
from bintangle.operators import cuts, emit, enrichment, graph, matrix, order, orient, vote
from bintangle.plans import pipeline
from bintangle.plans.config import Config
from bintangle.session import durable, load, number_rows, stored
from bintangle.sources import maps, text

RESOLUTION, CUTOFF = 500_000, 500_000
STRIDE, PER_GROUP, WIDTH = 40, 8, 3
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = _BASE + sql
        return f

    return register


_KEY = r"lower(regexp_replace({}, '^[\s\x{{0B}}\x{{A0}}]+|[\s\x{{0B}}\x{{A0}}]+$', '', 'g'))"
_BASE = rf"""
WITH names AS (SELECT {_KEY.format('scaffold')} AS key, min(scaffold) AS scaffold FROM scaffold_sizes WHERE scaffold IS NOT NULL GROUP BY 1),
sizes AS (SELECT scaffold, arg_max(struct_pack(s := size), line_no).s AS size FROM scaffold_sizes WHERE scaffold IS NOT NULL GROUP BY 1),
bb AS (
  SELECT b.map_id, b.bin_id, coalesce(n.scaffold, b.scaffold) AS scaffold, b.start, b.stop, b.line_no AS ord,
    CASE WHEN regexp_full_match(trim(x.bias_txt), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') OR lower(trim(x.bias_txt)) IN ('nan', 'inf', '-inf', '+inf', 'infinity') THEN CAST(trim(x.bias_txt) AS DOUBLE) ELSE 0.0 END AS bias
  FROM bins b LEFT JOIN biases x ON x.line_no = b.line_no LEFT JOIN names n ON n.key = {_KEY.format('b.scaffold')} WHERE x.bias_txt IS DISTINCT FROM 'nan'),
latest AS (
  SELECT i, j, v FROM (SELECT least(b1, b2) AS i, greatest(b1, b2) AS j, CASE WHEN NOT isnan(v) THEN v END AS v, loaded_at FROM contacts WHERE b1 IS NOT NULL AND b2 IS NOT NULL)
  QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY loaded_at DESC NULLS LAST, v DESC NULLS LAST) = 1),
cc AS (SELECT x.map_id, i, j, v FROM latest JOIN bb x ON x.bin_id = i JOIN bb y ON y.bin_id = j WHERE x.map_id = y.map_id AND v > 0 AND v < 'inf'::DOUBLE),
sym AS (SELECT map_id, i, j, v FROM cc UNION ALL SELECT map_id, j, i, v FROM cc WHERE i <> j),
rs AS (SELECT map_id, i, sum(v) AS row_sum FROM sym GROUP BY 1, 2),
kept AS (SELECT bb.* FROM bb WHERE bin_id IN (SELECT i FROM rs)),
pl AS (SELECT map_id, bin_id, scaffold, row_number() OVER (PARTITION BY map_id ORDER BY ord, bin_id) - 1 AS pos FROM kept),
nb AS (SELECT map_id, count(*) AS n FROM pl GROUP BY 1),
atp AS (SELECT s.map_id, a.pos AS i, b.pos AS j, s.v FROM sym s JOIN pl a ON a.bin_id = s.i JOIN pl b ON b.bin_id = s.j),
rk AS (SELECT map_id, i, j, v, row_number() OVER (PARTITION BY map_id, i ORDER BY v DESC, j DESC) - 1 AS k FROM atp),
grp AS (SELECT map_id, bin_id, scaffold, pos, pos // {STRIDE} + 1 AS group_id FROM pl),
tally AS (
  SELECT g.map_id, g.group_id, g.scaffold, g.n_in, t.n_total, round(100.0::DOUBLE * n_in / n_total, 2) AS pct
  FROM (SELECT map_id, group_id, scaffold, count(*) AS n_in FROM grp GROUP BY ALL) g JOIN (SELECT map_id, scaffold, count(*) AS n_total FROM kept GROUP BY ALL) t ON t.map_id = g.map_id AND t.scaffold = g.scaffold),
asg AS (SELECT t.map_id, t.group_id, t.scaffold, kept.bin_id FROM tally t JOIN kept ON kept.map_id = t.map_id AND kept.scaffold = t.scaffold WHERE pct >= 51),
sc AS (
  SELECT *, row_number() OVER (PARTITION BY map_id, group_id ORDER BY node_count DESC, first_bin) AS place
  FROM (SELECT map_id, group_id, scaffold, count(*) AS node_count, min(bin_id) AS first_bin FROM asg GROUP BY ALL)),
flat AS (
  SELECT a.map_id, a.group_id, a.bin_id, s.place, s.node_count, coalesce(s.before, 0) AS off, row_number() OVER (PARTITION BY a.map_id, a.group_id, a.scaffold ORDER BY a.bin_id) - 1 AS k, s.first_bin % 2 = 1 AS minus
  FROM asg a JOIN (SELECT *, sum(node_count) OVER (PARTITION BY map_id, group_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sc) s ON s.map_id = a.map_id AND s.group_id = a.group_id AND s.scaffold = a.scaffold),
placed AS (SELECT map_id, group_id, bin_id, (off + CASE WHEN minus THEN node_count - 1 - k ELSE k END)::BIGINT AS pos FROM flat),
ov AS (
  SELECT r.map_id, r.i, r.n, r.i AS c, (hit + least(greatest(r.i - filled - (r.n - 1 - r.i - above), 0), r.i + 1 - filled_in))::BIGINT AS x
  FROM (SELECT nb.map_id, nb.n, q.i, count(rk.k) AS filled, count(*) FILTER (rk.j <= q.i AND rk.k < q.i) AS hit, count(*) FILTER (rk.j <= q.i) AS filled_in, count(*) FILTER (rk.j > q.i) AS above
    FROM nb JOIN (SELECT unnest(generate_series(1, (SELECT max(n) FROM nb))) AS i) q ON q.i < nb.n LEFT JOIN rk ON rk.map_id = nb.map_id AND rk.i = q.i GROUP BY 1, 2, 3) r),
tail AS (
  SELECT ov.*, CASE WHEN x <= greatest(0, 2 * c - n) THEN 1.0 WHEN x > c THEN 0.0 ELSE least(1.0, (
    SELECT sum(exp(lgamma(c + 1.0::DOUBLE) - lgamma(q.k + 1.0::DOUBLE) - lgamma(c - q.k + 1.0::DOUBLE) + lgamma(n - c + 1.0::DOUBLE) - lgamma(c - q.k + 1.0::DOUBLE) - lgamma(n - c - c + q.k + 1.0::DOUBLE)
      - lgamma(n + 1.0::DOUBLE) + lgamma(c + 1.0::DOUBLE) + lgamma(n - c + 1.0::DOUBLE))) FROM (SELECT unnest(generate_series(ov.x, ov.c)) AS k) q)) END AS p FROM ov),
fl AS (SELECT map_id, i, CASE WHEN round(p, 9) < 0.05 THEN 1 ELSE 0 END AS flag FROM tail),
con AS (
  SELECT map_id, i, flag, CASE WHEN count(*) OVER r = {WIDTH} THEN sum(flag) OVER l - sum(flag) OVER r ELSE 0 END::BIGINT AS contrast FROM fl
  WINDOW l AS (PARTITION BY map_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING), r AS (PARTITION BY map_id ORDER BY i ROWS BETWEEN {WIDTH} FOLLOWING AND {2 * WIDTH - 1} FOLLOWING)),
so AS (
  SELECT scaffold, size, (row_number() OVER (ORDER BY scaffold) - 1) // {PER_GROUP} + 1 AS group_id, (row_number() OVER (ORDER BY scaffold) - 1) % {PER_GROUP} + 1 AS ord, coalesce(ceil(size / {RESOLUTION}.0::DOUBLE) = 1, false) AS is_small,
    CASE WHEN line % 2 = 0 THEN '+' ELSE '-' END AS orientation FROM (SELECT sizes.scaffold, sizes.size, max(z.line_no) AS line FROM sizes JOIN scaffold_sizes z ON z.scaffold = sizes.scaffold WHERE sizes.size IS NOT NULL GROUP BY ALL)),
tr AS (
  SELECT * FROM (SELECT group_id, ord, scaffold, is_small, lag(scaffold) OVER w AS "left", lead(scaffold) OVER w AS "right" FROM so WINDOW w AS (PARTITION BY group_id ORDER BY ord)) WHERE is_small AND ("left" IS NOT NULL OR "right" IS NOT NULL)),
ky AS (SELECT DISTINCT s1, s2 FROM (SELECT scaffold AS s1, o AS s2 FROM (SELECT scaffold, unnest(["left", "right"]) AS o FROM tr) WHERE o IS NOT NULL UNION ALL SELECT o, scaffold FROM (SELECT scaffold, unnest(["left", "right"]) AS o FROM tr) WHERE o IS NOT NULL)),
vp AS (
  SELECT a.scaffold AS s1, p1, b.scaffold AS s2, p2 FROM valid_pairs v JOIN names a ON a.key = {_KEY.format('v.s1')} JOIN names b ON b.key = {_KEY.format('v.s2')} WHERE p1 IS NOT NULL AND p2 IS NOT NULL
  AND EXISTS (SELECT 1 FROM ky WHERE ky.s1 = a.scaffold AND ky.s2 = b.scaffold)),
cs AS (SELECT n.scaffold, list_sort(list_distinct(list(coord))) AS coords FROM cut_sites c JOIN names n ON n.key = {_KEY.format('c.scaffold')} WHERE coord IS NOT NULL GROUP BY 1),
dna AS (
  SELECT doc_id AS name, source, doc_id AS ord, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTANACGTACGTACGT') AS seq FROM documents),
dord AS (SELECT source AS group_id, name, row_number() OVER (PARTITION BY source ORDER BY name) AS ord, CASE WHEN name % 2 = 0 THEN '+' ELSE '-' END AS orientation, seq FROM dna WHERE source IS NOT NULL)
"""


def _six(c: str) -> Column:
    return F.round(F.col(c), 6).alias(c)


def _bins(spark: SparkSession, sf: str) -> DataFrame:
    return maps.read_bins(load(spark, sf, "bins"), load(spark, sf, "biases"), load(spark, sf, "scaffold_sizes"))


def _cells(spark: SparkSession, sf: str, bins: DataFrame | None = None) -> DataFrame:
    """Contacts of known bins; ``bins`` may be given if they are at hand."""
    return maps.read_contacts(load(spark, sf, "contacts"), _bins(spark, sf) if bins is None else bins)


def _sym(spark: SparkSession, sf: str) -> DataFrame:
    return maps.symmetric(_cells(spark, sf))


def _places(spark: SparkSession, sf: str, cells: DataFrame | None = None, bins: DataFrame | None = None) -> DataFrame:
    """Places of the bins that have contacts; ``cells`` and ``bins`` may be given if they are at hand."""
    bins = _bins(spark, sf) if bins is None else bins
    return matrix.positions(matrix.keep_rows(bins, maps.symmetric(_cells(spark, sf, bins) if cells is None else cells)))


def _at(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symmetric cells at places, places, and bins of each map."""
    bins = durable(_bins(spark, sf))
    cells = stored(_cells(spark, sf, bins))
    places = durable(_places(spark, sf, cells, bins))
    return matrix.gather(cells, places, both=True), places, places.groupBy("map_id").agg(F.count("*").alias("n"))


def _grouped(spark: SparkSession, sf: str, cells: DataFrame | None = None, bins: DataFrame | None = None) -> DataFrame:
    places = durable(_places(spark, sf, cells, bins))
    return cuts.groups_from_cuts(places, places.where((F.col("pos") > 0) & (F.col("pos") % STRIDE == 0)).select("map_id", F.col("pos").alias("cut")))


def _tally(spark: SparkSession, sf: str, cells: DataFrame | None = None, bins: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    bins = durable(_bins(spark, sf)) if bins is None else bins
    grouped = durable(_grouped(spark, sf, cells, bins))
    kept = durable(bins.join(grouped.select("bin_id"), "bin_id", "left_semi"))  # only bins that are in a group count
    return vote.tally(grouped, kept), kept


def _assigned(spark: SparkSession, sf: str, cells: DataFrame | None = None, bins: DataFrame | None = None) -> DataFrame:
    tallied, bins = _tally(spark, sf, cells, bins)
    return vote.assigned_bins(tallied, bins)


def _given_order(assigned: DataFrame) -> DataFrame:
    return order.group_scaffolds(assigned).withColumn("ord", F.col("place")).withColumn("orientation", F.when(F.col("bin_ids")[0] % 2 == 1, "-").otherwise("+"))


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return maps.read_sizes(load(spark, sf, "scaffold_sizes"))


def _size_order(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes in name order, eight to a group."""
    table = load(spark, sf, "scaffold_sizes").where("scaffold IS NOT NULL").groupBy("scaffold").agg(F.max_by("size", "line_no").alias("size"), F.max("line_no").alias("line")).where("size IS NOT NULL")
    df = maps.with_bin_count(number_rows(table, "scaffold", name="_at"), RESOLUTION)
    return df.select("scaffold", "size", F.expr(f"_at div {PER_GROUP} + 1").alias("group_id"), (F.col("_at") % PER_GROUP + 1).alias("ord"), "is_small", F.when(F.col("line") % 2 == 0, "+").otherwise("-").alias("orientation"))


def _neighbour_pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ordered = _size_order(spark, sf)
    keys = orient.pair_keys(orient.neighbours(ordered))
    return ordered, keys, maps.read_pairs(load(spark, sf, "valid_pairs"), keys, load(spark, sf, "scaffold_sizes"))


def _dna(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Sequences from the letters of the documents, and their order: by id within each source, turned by parity; texts without a source are left over."""
    letters = F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", ""))
    seqs = load(spark, sf, "documents").select(F.col("doc_id").alias("name"), "source", F.col("doc_id").alias("ord"), F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTANACGTACGTACGT").alias("seq"))
    placed = seqs.where("source IS NOT NULL").select(F.col("source").alias("group_id"), "name", F.row_number().over(Window.partitionBy("source").orderBy("name")).alias("ord"), F.when(F.col("name") % 2 == 0, "+").otherwise("-").alias("orientation"))
    return seqs, placed


# scans


@_query("scan1_bins", "SELECT map_id, bin_id, scaffold, start, stop, round(bias, 6) AS bias, ord FROM bb")
def _(spark, sf):
    return _bins(spark, sf).select("map_id", "bin_id", "scaffold", "start", "stop", _six("bias"), "ord")


@_query("scan1_allowed_bins", "SELECT map_id, bin_id, scaffold FROM bb WHERE bin_id IN (SELECT b1 FROM contacts WHERE v > 50 AND NOT isnan(v))")
def _(spark, sf):
    allow = load(spark, sf, "contacts").where("v > 50 AND NOT isnan(v)").select(F.col("b1").alias("bin_id"))
    return maps.read_bins(load(spark, sf, "bins"), load(spark, sf, "biases"), load(spark, sf, "scaffold_sizes"), allow).select("map_id", "bin_id", "scaffold")


@_query("scan2_contacts", "SELECT map_id, i, j, v FROM sym")
def _(spark, sf):
    return _sym(spark, sf)


@_query("scan3_sizes", "SELECT scaffold, size FROM sizes")
def _(spark, sf):
    return _sizes(spark, sf)


@_query("scan4_bin_counts", f"SELECT scaffold, size, ceil(size / {RESOLUTION}.0::DOUBLE)::BIGINT AS bin_count, ceil(size / {RESOLUTION}.0::DOUBLE) = 1 AS is_small FROM sizes")
def _(spark, sf):
    return maps.with_bin_count(_sizes(spark, sf), RESOLUTION)


@_query("scan5_sites", "SELECT sizes.scaffold, array_to_string(coalesce(coords, []), ',') AS coords FROM sizes LEFT JOIN cs ON cs.scaffold = sizes.scaffold")
def _(spark, sf):
    return maps.read_sites(load(spark, sf, "cut_sites"), load(spark, sf, "scaffold_sizes")).withColumn("coords", F.array_join("coords", ","))


@_query("scan6_pairs", "SELECT s1, p1, s2, p2 FROM vp")
def _(spark, sf):
    return _neighbour_pairs(spark, sf)[2]


@_query("scan9_sections", "SELECT line_id, section FROM (SELECT line_id, line, sum(CASE WHEN line LIKE '#%' THEN 1 ELSE 0 END) OVER (PARTITION BY delivery, file_kind ORDER BY line_no, line_id)::BIGINT AS section FROM raw_lines) WHERE NOT line LIKE '#%'")
def _(spark, sf):
    lines = load(spark, sf, "raw_lines").withColumn("at", F.struct("line_no", "line_id"))
    return text.sections(lines, ["delivery", "file_kind"], "at").select("line_id", "section")


# projections and filters


@_query("proj1_distance", "SELECT map_id, i, j, round(2 - v / sum(v) OVER (PARTITION BY map_id, i), 6) AS d FROM sym")
def _(spark, sf):
    return matrix.distances(_sym(spark, sf)).select("map_id", "i", "j", _six("d"))


@_query("proj2_similarity", "SELECT map_id, i, j, round(v, 6) AS s FROM sym")
def _(spark, sf):
    cells = _sym(spark, sf)
    return matrix.similarities(matrix.distances(cells), matrix.row_sums(cells)).select("map_id", "i", "j", _six("s"))


@_query("proj3_log", "SELECT map_id, i, j, round(log10(v + 1), 6) AS lg FROM sym")
def _(spark, sf):
    return matrix.log_cells(_sym(spark, sf)).select("map_id", "i", "j", _six("lg"))


@_query("proj4_unlog", "SELECT map_id, i, j, round(v, 6) AS v FROM sym")
def _(spark, sf):
    return matrix.unlog_cells(matrix.log_cells(_sym(spark, sf))).select("map_id", "i", "j", _six("v"))


@_query("proj5_log_plain", "SELECT map_id, i, j, round(log10(v), 6) AS lg FROM sym")
def _(spark, sf):
    return matrix.log_cells(_sym(spark, sf), offset=0.0).select("map_id", "i", "j", _six("lg"))


@_query("proj6_zero_rows", "SELECT map_id, bin_id FROM kept")
def _(spark, sf):
    return matrix.keep_rows(_bins(spark, sf), _sym(spark, sf)).select("map_id", "bin_id")


@_query("proj7_bias_range", "SELECT map_id, bin_id, round(bias, 6) AS bias FROM kept WHERE bias BETWEEN 0.5::DOUBLE AND 1.5::DOUBLE")
def _(spark, sf):
    return matrix.keep_rows(_bins(spark, sf), _sym(spark, sf), 0.5, 1.5).select("map_id", "bin_id", _six("bias"))


@_query("proj9_kept_cells", "SELECT map_id, i, j, v FROM sym WHERE i IN (SELECT bin_id FROM kept WHERE bias BETWEEN 0.5::DOUBLE AND 1.5::DOUBLE) AND j IN (SELECT bin_id FROM kept WHERE bias BETWEEN 0.5::DOUBLE AND 1.5::DOUBLE)")
def _(spark, sf):
    cells = maps.symmetric(stored(_cells(spark, sf)))
    return matrix.keep_cells(cells, matrix.keep_rows(_bins(spark, sf), cells, 0.5, 1.5))


@_query("proj10_labels", "SELECT bin_id, scaffold || '_' || bin_id AS label FROM bb")
def _(spark, sf):
    return _bins(spark, sf).select("bin_id", F.concat_ws("_", "scaffold", "bin_id").alias("label"))


@_query("proj15_gather", "SELECT map_id, i, j, v FROM atp")
def _(spark, sf):
    return _at(spark, sf)[0]


@_query("proj17_condensed", "SELECT map_id, i, j, round(2 - v / s, 6) AS d FROM (SELECT *, sum(v) OVER (PARTITION BY map_id, i) AS s FROM atp) WHERE i < j")
def _(spark, sf):
    return matrix.upper_triangle(matrix.distances(_at(spark, sf)[0])).select("map_id", "i", "j", _six("d"))


@_query("join13_groups", "SELECT map_id, bin_id, pos, group_id FROM grp")
def _(spark, sf):
    return _grouped(spark, sf)


# aggregates and statistics


@_query("agg1_row_sums", "SELECT map_id, i, round(row_sum, 6) AS row_sum FROM rs")
def _(spark, sf):
    return matrix.row_sums(_sym(spark, sf)).select("map_id", "i", _six("row_sum"))


@_query("agg2_counts", "SELECT map_id, count(*) AS n_edges, round(sum(v), 4) AS total FROM cc WHERE i < j GROUP BY 1")
def _(spark, sf):
    return matrix.upper_triangle(_cells(spark, sf)).groupBy("map_id").agg(F.count("*").alias("n_edges"), F.round(F.sum("v"), 4).alias("total"))


@_query("agg3_community_order", """, com AS (SELECT map_id, scaffold AS community, count(*) AS n, min(pos) AS seen FROM pl GROUP BY 1, 2)
SELECT map_id, community, n, row_number() OVER w AS place, (sum(n) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS cut FROM com WINDOW w AS (PARTITION BY map_id ORDER BY n DESC, seen)""")
def _(spark, sf):
    _, places, _ = _at(spark, sf)
    return vote.community_order(places.join(_bins(spark, sf).select("bin_id", F.col("scaffold").alias("community")), "bin_id"))


@_query("agg4_scaffold_bins", "SELECT map_id, scaffold, string_agg(bin_id::VARCHAR, ',' ORDER BY bin_id) AS bin_ids, count(*) AS node_count FROM bb GROUP BY 1, 2")
def _(spark, sf):
    return vote.scaffold_bins(_bins(spark, sf)).withColumn("bin_ids", F.array_join("bin_ids", ","))


@_query("agg5_votes", "SELECT map_id, group_id, scaffold, n_in, n_total, pct, pct >= 51 AS assigned FROM tally")
def _(spark, sf):
    return _tally(spark, sf)[0]


@_query("agg5_assigned", "SELECT map_id, group_id, scaffold, bin_id FROM asg")
def _(spark, sf):
    return _assigned(spark, sf)


@_query("agg6_assessment", """SELECT b.map_id, n_bins, n_assigned, n_false, round(100.0::DOUBLE * n_false / n_bins, 4) AS error_pct FROM (SELECT map_id, count(*) AS n_bins FROM kept GROUP BY 1) b
JOIN (SELECT map_id, sum(CASE WHEN pct >= 51 THEN n_total ELSE 0 END)::BIGINT AS n_assigned, sum(CASE WHEN pct < 51 THEN n_in ELSE 0 END)::BIGINT AS n_false FROM tally GROUP BY 1) t ON t.map_id = b.map_id""")
def _(spark, sf):
    return vote.assess(*_tally(spark, sf))


@_query("agg7_overlap", "SELECT map_id, i, n, c, x FROM ov")
def _(spark, sf):
    at, _, n_bins = _at(spark, sf)
    return enrichment.rank_overlap(matrix.ranks(at), n_bins)


def _tail(spark: SparkSession, sf: str) -> DataFrame:
    at, _, n_bins = _at(spark, sf)
    return enrichment.hypergeometric_tail(enrichment.rank_overlap(matrix.ranks(at), n_bins), "x", "n", "c", "c")


@_query("agg8_tail", "SELECT map_id, i, round(p, 6) AS p FROM tail")
def _(spark, sf):
    return _tail(spark, sf).select("map_id", "i", _six("p"))


def _flags(spark: SparkSession, sf: str) -> DataFrame:
    return enrichment.significant(_tail(spark, sf).withColumn("p", F.round("p", 9))).select("map_id", "i", "flag")


@_query("agg9_flags", "SELECT map_id, i, flag FROM fl")
def _(spark, sf):
    return _flags(spark, sf)


@_query("agg10_contrast", "SELECT map_id, i, contrast FROM con")
def _(spark, sf):
    return enrichment.half_window_contrast(_flags(spark, sf), WIDTH).select("map_id", "i", F.col("contrast").cast("bigint").alias("contrast"))


@_query("agg10_best", 'SELECT map_id, max(contrast) AS best, arg_max(i, contrast * 1000000 - i) AS "at" FROM con GROUP BY 1')
def _(spark, sf):
    return enrichment.leftmost_best(enrichment.half_window_contrast(_flags(spark, sf), WIDTH)).select("map_id", F.col("best").cast("bigint").alias("best"), "at")


@_query("agg11_breakpoint", f"SELECT map_id, min(i) FILTER (contrast = {WIDTH}) + {WIDTH} AS cut FROM con GROUP BY 1")
def _(spark, sf):
    return enrichment.first_breakpoint(_flags(spark, sf), WIDTH)


@_query("agg12_cuts")
def _(spark, sf):
    """Cuts of the clustered maps before denoising."""
    _, n_bins, at = pipeline.ordered_map(_bins(spark, sf), stored(_cells(spark, sf)))
    return cuts.find_cuts(n_bins, at, clean=False)


@_query("agg13_clean_cuts")
def _(spark, sf):
    _, n_bins, at = pipeline.ordered_map(_bins(spark, sf), stored(_cells(spark, sf)))
    return cuts.find_cuts(n_bins, at)


@_query("pipe1_groups")
def _(spark, sf):
    """The grouping part end to end, with the default settings, over all bins; those of scaffolds of unknown size are marked."""
    return pipeline.find_groups(durable(_bins(spark, sf)), stored(_cells(spark, sf)), _sizes(spark, sf), Config(resolution=RESOLUTION))


def _assembled(spark: SparkSession, sf: str) -> DataFrame:
    """Groups, order and orientation over all maps, every part fed the rows of the one before, with the default settings and each map's own bin width."""
    config, sizes = Config(resolution=RESOLUTION), durable(_sizes(spark, sf))
    bins = durable(_bins(spark, sf))
    cells = stored(_cells(spark, sf))
    widths = durable(maps.bin_widths(bins))
    ordered = durable(pipeline.order_scaffolds(durable(pipeline.find_groups(bins, cells, sizes, config)), cells, config))
    keys = orient.pair_keys(orient.neighbours(pipeline.mark_small(ordered, sizes, config, widths)))
    pairs = durable(maps.read_pairs(load(spark, sf, "valid_pairs"), keys, load(spark, sf, "scaffold_sizes")))
    sites = maps.read_sites(load(spark, sf, "cut_sites"), load(spark, sf, "scaffold_sizes"))
    return pipeline.orient_scaffolds(ordered, sizes, sites, pairs, config, widths)


@_query("pipe1_states")
def _(spark, sf):
    """The grouping part cut by two states."""
    return pipeline.find_groups(durable(_bins(spark, sf)), stored(_cells(spark, sf)), _sizes(spark, sf), Config(resolution=RESOLUTION, strategy="states"))


@_query("pipe2_oriented")
def _(spark, sf):
    """Parts 1 to 3 end to end."""
    return _assembled(spark, sf)


@_query("pipe3_joined")
def _(spark, sf):
    """All four parts end to end. No table has the sequences of scaffolds, so each has letters drawn from its name."""
    letters = F.translate(F.concat(*[F.sha2(F.concat_ws("/", "scaffold", F.lit(k)), 512) for k in range(3)]), "0123456789abcdef", "ACGTACGTACGTACGT")
    seqs = load(spark, sf, "scaffold_sizes").where("scaffold IS NOT NULL").groupBy("scaffold").agg(F.min("line_no").alias("ord")).select(F.col("scaffold").alias("name"), letters.alias("seq"), "ord")
    return pipeline.join_sequences(durable(_assembled(spark, sf)), seqs)


@_query("agg14_clip", """, ex AS (SELECT nb.map_id, nb.n * nb.n - count(atp.v) AS zeros, nb.n * nb.n AS cells FROM nb LEFT JOIN atp ON atp.map_id = nb.map_id GROUP BY nb.map_id, nb.n),
every AS (SELECT map_id, v FROM atp UNION ALL SELECT map_id, 0.0 FROM (SELECT map_id, unnest(generate_series(1, zeros)) FROM ex))
SELECT map_id, 0.01::DOUBLE AS q, round(quantile_cont(v, 0.01), 6) AS bound FROM every GROUP BY 1 UNION ALL SELECT map_id, 0.98::DOUBLE, round(quantile_cont(v, 0.98), 6) FROM every GROUP BY 1""")
def _(spark, sf):
    at, _, n_bins = _at(spark, sf)
    return matrix.clip_bounds(stored(at), n_bins).select("map_id", "q", _six("bound"))


@_query("agg15_edge_sites", f"""SELECT s.scaffold, greatest(1, len(list_filter(coalesce(coords, []), lambda c: c <= {CUTOFF}))) AS res_left,
greatest(1, len(list_filter(coalesce(coords, []), lambda c: c > {CUTOFF} AND c > s.size - {CUTOFF}))) AS res_right FROM sizes s LEFT JOIN cs ON cs.scaffold = s.scaffold WHERE s.size IS NOT NULL""")
def _(spark, sf):
    sizes = _sizes(spark, sf).where("size IS NOT NULL")
    return orient.edge_sites(maps.read_sites(load(spark, sf, "cut_sites"), load(spark, sf, "scaffold_sizes")), sizes, F.lit(CUTOFF)).select("scaffold", F.col("res_left").cast("bigint").alias("res_left"), F.col("res_right").cast("bigint").alias("res_right"))


@_query("agg16_outlines", "SELECT map_id, group_id, min(pos) AS from_pos, max(pos) + 1 AS to_pos FROM grp GROUP BY 1, 2")
def _(spark, sf):
    return vote.group_outlines(_grouped(spark, sf))


@_query("agg17_assembly", """SELECT (SELECT count(DISTINCT group_id) FROM dord) AS n_groups, (SELECT count(*) FROM dord) AS n_joined, (SELECT sum(length(seq))::BIGINT FROM dord) AS joined_length,
(SELECT count(*) FROM dna WHERE source IS NULL) AS n_left, (SELECT coalesce(sum(length(seq)), 0)::BIGINT FROM dna WHERE source IS NULL) AS left_length, (SELECT count(*) - count(DISTINCT group_id) FROM dord) AS n_gaps, (SELECT (count(*) - count(DISTINCT group_id)) * 100 FROM dord) AS gap_ns""")
def _(spark, sf):
    seqs, placed = _dna(spark, sf)
    return emit.assembly_statistics(placed, seqs)


# ranks, order, candidates


@_query("sort1_ranks", "SELECT map_id, i, j, k FROM rk")
def _(spark, sf):
    return matrix.ranks(_at(spark, sf)[0]).select("map_id", "i", "j", "k")


@_query("sort3_scaffolds", "SELECT map_id, group_id, scaffold, node_count, place FROM sc")
def _(spark, sf):
    return order.group_scaffolds(_assigned(spark, sf)).select("map_id", "group_id", "scaffold", "node_count", "place")


@_query("sort6_groups_by_size", "SELECT map_id, group_id, bp, row_number() OVER (PARTITION BY map_id ORDER BY bp DESC, group_id) AS chrom FROM (SELECT map_id, group_id, sum(size)::BIGINT AS bp FROM (SELECT DISTINCT map_id, group_id, scaffold FROM asg) a JOIN sizes ON sizes.scaffold = a.scaffold WHERE size IS NOT NULL GROUP BY 1, 2)")
def _(spark, sf):
    sizes = _sizes(spark, sf).where("size IS NOT NULL")
    return vote.rank_groups(_assigned(spark, sf).join(sizes.select("scaffold"), "scaffold", "left_semi"), sizes)


@_query("sort14_candidates", "SELECT map_id, group_id, count(*) AS n, list_reduce(list_transform(generate_series(1, count(*)), lambda k: k::DOUBLE), lambda product, k: product * k * 2, 0.5::DOUBLE) AS candidates FROM sc GROUP BY 1, 2")
def _(spark, sf):
    return order.candidate_counts(order.group_scaffolds(_assigned(spark, sf)))


@_query("order3_places", "SELECT map_id, group_id, bin_id, pos FROM placed")
def _(spark, sf):
    return order.flatten_order(_given_order(_assigned(spark, sf)))


@_query("order10_score", """, h AS (SELECT n, sum(1.0::DOUBLE / n) OVER (ORDER BY n) AS h FROM (SELECT unnest(generate_series(1, 5000)) AS n)), hh AS (SELECT 0 AS n, 0.0 AS h UNION ALL SELECT n, h FROM h),
gn AS (SELECT map_id, group_id, count(*) AS n FROM placed GROUP BY 1, 2),
ed AS (SELECT cc.map_id, a.group_id, abs(a.pos - b.pos) AS d, v FROM cc JOIN placed a ON a.bin_id = i JOIN placed b ON b.bin_id = j AND b.group_id = a.group_id WHERE i <> j)
SELECT ed.map_id, ed.group_id, round(sum(v), 4) AS total, round(sum(v * (x.h - y.h)) / sum(v), 6) AS score FROM ed JOIN gn ON gn.map_id = ed.map_id AND gn.group_id = ed.group_id JOIN hh x ON x.n = gn.n - 1 JOIN hh y ON y.n = d - 1 GROUP BY 1, 2""")
def _(spark, sf):
    bins = durable(_bins(spark, sf))
    cells = stored(_cells(spark, sf, bins))
    return order.score_orders(cells, order.flatten_order(_given_order(_assigned(spark, sf, cells, bins)))).select("map_id", "group_id", F.round("total", 4).alias("total"), _six("score"))


@_query("order7_search")
def _(spark, sf):
    bins = durable(_bins(spark, sf))
    cells = stored(_cells(spark, sf, bins))
    return order.order_groups(durable(_assigned(spark, sf, cells, bins)), cells).withColumn("score", F.round("score", 6))


# neighbours and orientation


@_query("orient9_neighbours", 'SELECT group_id, ord, scaffold, "left", "right" FROM tr')
def _(spark, sf):
    return orient.neighbours(_size_order(spark, sf))


@_query("orient10_keys", "SELECT s1, s2 FROM ky")
def _(spark, sf):
    return orient.pair_keys(orient.neighbours(_size_order(spark, sf)))


_LINKS = f"""SELECT ky.s1 AS a, ky.s2 AS b, count(p.pa) AS n, count(*) FILTER (pb <= {CUTOFF}) AS n_start, count(*) FILTER (sb - pb <= {CUTOFF}) AS n_end,
  count(*) FILTER (pa >= sa / 2 AND pb BETWEEN 0 AND {CUTOFF}) AS n_far_start, count(*) FILTER (pa < sa / 2 AND pb BETWEEN 0 AND {CUTOFF}) AS n_near_start,
  count(*) FILTER (pa >= sa / 2 AND pb BETWEEN sb - {CUTOFF} AND sb) AS n_far_end, count(*) FILTER (pa < sa / 2 AND pb BETWEEN sb - {CUTOFF} AND sb) AS n_near_end
FROM ky LEFT JOIN (
  SELECT *, max(forward) OVER (PARTITION BY a, b) AS best FROM (SELECT u.*, z.size AS sb, y.size AS sa FROM (SELECT s1 AS a, p1 AS pa, s2 AS b, p2 AS pb, 1 AS forward FROM vp UNION ALL SELECT s2, p2, s1, p1, 0 FROM vp) u JOIN so z ON z.scaffold = u.b JOIN so y ON y.scaffold = u.a)) p
ON p.a = ky.s1 AND p.b = ky.s2 AND p.forward = p.best GROUP BY 1, 2"""


@_query("orient11_links", _LINKS)
def _(spark, sf):
    _, keys, pairs = _neighbour_pairs(spark, sf)
    return orient.link_counts(keys, pairs, _sizes(spark, sf).where("size IS NOT NULL"), CUTOFF).drop("cutoff")


@_query("orient14_small")
def _(spark, sf):
    ordered, _, pairs = _neighbour_pairs(spark, sf)
    sites = maps.read_sites(load(spark, sf, "cut_sites"), load(spark, sf, "scaffold_sizes"))
    return orient.orient_small(ordered, _sizes(spark, sf).where("size IS NOT NULL"), sites, pairs, CUTOFF, RESOLUTION)


def _sites_within(cutoff: str) -> str:
    return f"SELECT so.scaffold, greatest(1, len(list_filter(coalesce(coords, []), lambda c: c <= {cutoff}))) AS res_left, greatest(1, len(list_filter(coalesce(coords, []), lambda c: c > {cutoff} AND c > so.size - {cutoff}))) AS res_right FROM so LEFT JOIN cs ON cs.scaffold = so.scaffold"


#: The same step by step along each group: every scaffold sees the orientation its left neighbour got, and the given one of its right neighbour.
SQL["orient14_small"] = (
    _BASE.replace("WITH names", "WITH RECURSIVE names", 1)
    + f""", lk AS ({_LINKS}), es AS ({_sites_within(str(CUTOFF))}), hs AS ({_sites_within("so.size / 2")}),
seen AS (SELECT so.*, lag(scaffold) OVER w AS "left", lead(scaffold) OVER w AS "right", lead(orientation) OVER w AS given, count(*) OVER (PARTITION BY group_id) AS n_group FROM so WINDOW w AS (PARTITION BY group_id ORDER BY ord)),
met AS (
  SELECT seen.group_id, seen.ord, seen.scaffold, orientation, is_small, given, n_group, e.res_right AS r, h.res_left AS hl, h.res_right AS hr, el.res_left AS ll, el.res_right AS lr, er.res_left AS rl, er.res_right AS rr, l, x
  FROM seen LEFT JOIN es e ON e.scaffold = seen.scaffold LEFT JOIN hs h ON h.scaffold = seen.scaffold LEFT JOIN es el ON el.scaffold = seen."left" LEFT JOIN es er ON er.scaffold = seen."right"
  LEFT JOIN lk l ON is_small AND l.a = seen.scaffold AND l.b = seen."left" LEFT JOIN lk x ON is_small AND x.a = seen.scaffold AND x.b = seen."right"),
turned AS (
  SELECT group_id, ord, scaffold, CASE WHEN NOT is_small OR n_group = 1 THEN orientation
      WHEN coalesce(CASE WHEN given = '+' THEN x.n_far_start / (hr + rl) ELSE x.n_far_end / (hr + rr) END, 0) >= coalesce(CASE WHEN given = '+' THEN x.n_near_start / (hl + rl) ELSE x.n_near_end / (hl + rr) END, 0) THEN '+' ELSE '-' END AS orientation
  FROM met WHERE ord = 1
  UNION ALL
  SELECT met.group_id, met.ord, met.scaffold, CASE WHEN NOT is_small THEN met.orientation
      WHEN met.ord < n_group THEN CASE WHEN coalesce(CASE WHEN given = '+' THEN x.n_start / (r + rl) ELSE x.n_end / (r + rr) END, 0) >= coalesce(CASE WHEN t.orientation = '-' THEN l.n_start / (r + ll) ELSE l.n_end / (r + lr) END, 0) THEN '+' ELSE '-' END
      WHEN coalesce(CASE WHEN t.orientation = '+' THEN l.n_near_end / (lr + hl) ELSE l.n_near_start / (ll + hl) END, 0) >= coalesce(CASE WHEN t.orientation = '+' THEN l.n_far_end / (lr + hr) ELSE l.n_far_start / (ll + hr) END, 0) THEN '+' ELSE '-' END
  FROM met JOIN turned t ON t.group_id = met.group_id AND met.ord = t.ord + 1)
SELECT group_id, ord, scaffold, orientation FROM turned"""
)


# graph kernels


@_query("graph1_leaf_order")
def _(spark, sf):
    at, _, n_bins = _at(spark, sf)
    return graph.leaf_order(n_bins, matrix.distances(at))


@_query("graph2_communities")
def _(spark, sf):
    cells = stored(_cells(spark, sf))
    return graph.communities(durable(_places(spark, sf, cells)), matrix.log_cells(cells).select("map_id", "i", "j", F.col("lg").alias("v")))


@_query("graph3_modularity", """, lab AS (SELECT cc.map_id, x.scaffold AS a, y.scaffold AS b, v FROM cc JOIN bb x ON x.bin_id = i JOIN bb y ON y.bin_id = j),
m AS (SELECT map_id, sum(v) AS m FROM lab GROUP BY 1), deg AS (SELECT map_id, c, sum(v) AS d FROM (SELECT map_id, a AS c, v FROM lab UNION ALL SELECT map_id, b, v FROM lab) GROUP BY 1, 2),
ins AS (SELECT map_id, a AS c, sum(v) AS w FROM lab WHERE a = b GROUP BY 1, 2)
SELECT deg.map_id, round(sum(coalesce(w, 0) / m - power(d / (2 * m), 2)), 6) AS modularity FROM deg JOIN m ON m.map_id = deg.map_id LEFT JOIN ins ON ins.map_id = deg.map_id AND ins.c = deg.c GROUP BY 1""")
def _(spark, sf):
    part = _bins(spark, sf).select("map_id", "bin_id", F.col("scaffold").alias("community"))
    return graph.modularity(part, _cells(spark, sf), ["map_id"]).select("map_id", _six("modularity"))


@_query("graph4_tail")
def _(spark, sf):
    cells = stored(_cells(spark, sf))
    places = durable(_places(spark, sf, cells))
    cut = places.groupBy("map_id").agg(F.expr("count(*) div 2").alias("cut"))
    return graph.tail_cuts(places, matrix.keep_cells(matrix.log_cells(cells).select("map_id", "i", "j", F.col("lg").alias("v")), places), cut)


# what the iterative kernels must hold, whatever they find; SQL gives the maps or groups and that it holds for each


@_query("graph1_checked", "SELECT map_id, n, true AS is_permutation FROM nb")
def _(spark, sf):
    """Clustered leaves: every old and every new place once."""
    at, _, n_bins = _at(spark, sf)
    leaves = graph.leaf_order(n_bins, matrix.distances(at)).groupBy("map_id").agg(F.count_distinct("pos").alias("new"), F.count_distinct("at").alias("old"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    return n_bins.join(leaves, "map_id", "left").select("map_id", "n", ((F.col("new") == F.col("n")) & (F.col("old") == F.col("n")) & (F.col("low") == 0) & (F.col("high") == F.col("n") - 1)).alias("is_permutation"))


@_query("graph2_checked", "SELECT map_id, n, true AS at_least_by_scaffold FROM nb")
def _(spark, sf):
    """Communities: every bin in one, and a modularity no less than that of the scaffolds."""
    cells = stored(_cells(spark, sf))
    places = durable(_places(spark, sf, cells))
    edges = durable(matrix.log_cells(cells).select("map_id", "i", "j", F.col("lg").alias("v")))
    found = durable(graph.communities(places, edges))
    given = places.join(_bins(spark, sf).select("bin_id", F.col("scaffold").alias("community")), "bin_id").select("map_id", "bin_id", "community")
    of = lambda part, name: graph.modularity(part, edges, ["map_id"]).withColumnRenamed("modularity", name)
    both = of(found.select("map_id", "bin_id", "community"), "q").join(of(given, "q_given"), "map_id")
    return found.groupBy("map_id").agg(F.count_distinct("bin_id").alias("n")).join(both, "map_id").select("map_id", "n", (F.col("q") >= F.col("q_given") - 1e-9).alias("at_least_by_scaffold"))


@_query("graph4_checked", "SELECT map_id, n, true AS is_partition FROM nb")
def _(spark, sf):
    """Cuts, and the communities behind the last one: every bin once, groups without gaps."""
    cells = stored(_cells(spark, sf))
    places, n_bins, at = pipeline.ordered_map(_bins(spark, sf), cells)
    return _partition(pipeline.cut_groups(places, n_bins, at, cells, Config(resolution=RESOLUTION)), n_bins)


def _partition(grouped: DataFrame, n_bins: DataFrame) -> DataFrame:
    own = grouped.groupBy("map_id", "group_id").agg(F.count_distinct("bin_id").alias("bins"), F.count_distinct("pos").alias("places"), (F.max("pos") - F.min("pos") + 1).alias("span"))
    of_map = own.groupBy("map_id").agg(F.sum("bins").alias("bins"), F.bool_and((F.col("bins") == F.col("places")) & (F.col("places") == F.col("span"))).alias("whole"), F.max("group_id").alias("last"), F.count("*").alias("n_groups"))
    return n_bins.join(of_map, "map_id", "left").select("map_id", "n", (F.col("whole") & (F.col("bins") == F.col("n")) & (F.col("last") == F.col("n_groups"))).alias("is_partition"))


@_query("graph6_checked", "SELECT map_id, n, true AS is_partition FROM nb")
def _(spark, sf):
    """Cuts by two states: they lie within the map and part it."""
    at, places, n_bins = _at(spark, sf)
    return _partition(cuts.groups_from_cuts(places, graph.state_cuts(n_bins, matrix.log_cells(at), width=5, rounds=5)), n_bins)


@_query("agg13_checked", "SELECT map_id, n, true AS is_partition FROM nb")
def _(spark, sf):
    """Cuts by rank overlap before denoising and after: both part the map, and denoising keeps only cuts that were there."""
    at, places, n_bins = _at(spark, sf)
    found = durable(cuts.find_both(n_bins, at))
    raw, clean = found.where("NOT clean").drop("clean"), found.where("clean").drop("clean")
    new = clean.join(raw, ["map_id", "cut"], "left_anti").groupBy("map_id").agg(F.count("*").alias("n_new"))
    both = _partition(cuts.groups_from_cuts(places, raw), n_bins).join(_partition(cuts.groups_from_cuts(places, clean), n_bins).select("map_id", F.col("is_partition").alias("clean")), "map_id")
    return both.join(new, "map_id", "left").select("map_id", "n", (F.col("is_partition") & F.col("clean") & F.col("n_new").isNull()).alias("is_partition"))


@_query("order7_checked", "SELECT map_id, group_id, count(*) AS n, true AS at_least_given FROM sc GROUP BY 1, 2")
def _(spark, sf):
    """The order found: every scaffold once, and a score no less than that of the order by falling size."""
    bins = durable(_bins(spark, sf))
    cells = stored(_cells(spark, sf, bins))
    assigned = durable(_assigned(spark, sf, cells, bins))
    found = order.order_groups(assigned, cells).groupBy("map_id", "group_id").agg(F.count_distinct("scaffold").alias("n"), F.max("ord").alias("last"), F.max("score").alias("score"))
    given = order.group_scaffolds(assigned).withColumn("ord", F.col("place")).withColumn("orientation", F.lit("+"))
    scored = order.score_orders(cells, order.flatten_order(given)).select("map_id", "group_id", F.col("score").alias("given"))
    return found.join(scored, ["map_id", "group_id"], "left").select("map_id", "group_id", "n", ((F.col("n") == F.col("last")) & (F.col("score") >= F.coalesce("given", F.lit(0.0)) - 1e-9)).alias("at_least_given"))


@_query("pipe1_checked", "SELECT map_id, 0::BIGINT AS n_twice, 0::BIGINT AS n_partly FROM nb")
def _(spark, sf):
    """Groups end to end: scaffolds that are in two groups, and scaffolds some of whose bins with contacts are left out."""
    bins, cells = durable(_bins(spark, sf)), stored(_cells(spark, sf))
    kept = matrix.keep_rows(bins, maps.symmetric(cells)).groupBy("map_id", "scaffold").agg(F.count("*").alias("n"))
    groups = pipeline.find_groups(bins, cells, _sizes(spark, sf), Config(resolution=RESOLUTION)).groupBy("map_id", "scaffold").agg(F.count_distinct("group_id").alias("n_groups"), F.count_distinct("bin_id").alias("n_bins"))
    return kept.join(groups, ["map_id", "scaffold"], "left").groupBy("map_id").agg(F.count_if(F.col("n_groups") > 1).alias("n_twice"), F.count_if(F.col("n_bins") < F.col("n")).alias("n_partly"))


@_query("graph5_changes", "SELECT map_id, pos AS cut FROM (SELECT map_id, pos, scaffold, lag(scaffold) OVER (PARTITION BY map_id ORDER BY pos) AS b FROM pl) WHERE b <> scaffold")
def _(spark, sf):
    return enrichment.community_changes(_places(spark, sf).join(_bins(spark, sf).select("bin_id", F.col("scaffold").alias("community")), "bin_id"))


@_query("graph6_state_cuts")
def _(spark, sf):
    at, _, n_bins = _at(spark, sf)
    return graph.state_cuts(n_bins, matrix.log_cells(at), width=5, rounds=5)


@_query("graph8_switch", f""", st AS (SELECT pl.map_id, pos, CASE WHEN bias > 1 AND NOT isnan(bias) THEN 1 ELSE 0 END AS s FROM pl JOIN bb ON bb.bin_id = pl.bin_id),
base AS (SELECT map_id, CASE WHEN sum(s) * 2 > count(*) THEN 1 ELSE 0 END AS b FROM st WHERE pos < {WIDTH} GROUP BY 1),
run AS (SELECT st.map_id, pos, sum((s <> b)::INT) OVER (PARTITION BY st.map_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WIDTH - 1} FOLLOWING) AS r, count(*) OVER (PARTITION BY st.map_id) AS n FROM st JOIN base ON base.map_id = st.map_id)
SELECT base.map_id, min(pos) FILTER (r = {WIDTH} AND pos < n - {WIDTH}) AS "at" FROM base JOIN run ON run.map_id = base.map_id GROUP BY 1""")
def _(spark, sf):
    states = _places(spark, sf).join(_bins(spark, sf).select("bin_id", "bias"), "bin_id").select("map_id", "pos", F.when((F.col("bias") > 1) & ~F.isnan("bias"), 1).otherwise(0).alias("state"))
    return enrichment.state_switch(states, WIDTH)


# sinks


@_query("sink2_group_lines", "SELECT map_id, group_id, bin_id || chr(9) || scaffold AS line FROM grp UNION ALL SELECT DISTINCT map_id, group_id, '### Chromosome group ' || group_id || ' ###' FROM grp")
def _(spark, sf):
    rows = _grouped(spark, sf).join(_bins(spark, sf).select("bin_id", "scaffold"), "bin_id")
    keyed = rows.select(F.struct("map_id", "group_id").alias("g"), "group_id", "map_id", F.col("pos").alias("ord"), "bin_id", "scaffold")
    body = text.section_lines(keyed.withColumn("group_id", F.col("group_id").cast("string")).withColumn("group_id", F.concat_ws(" ", "map_id", "group_id")), ["bin_id", "scaffold"])
    cut = F.split("group_id", " ")
    head = F.when(F.col("at") < 0, F.concat(F.lit("### Chromosome group "), cut[1], F.lit(" ###"))).otherwise(F.col("line"))
    return body.select(cut[0].cast("int").alias("map_id"), cut[1].cast("bigint").alias("group_id"), head.alias("line"))


@_query("sink4_report", "SELECT map_id, group_id, scaffold, scaffold || chr(9) || n_in || chr(9) || n_total || chr(9) || printf('%.1f', pct) || '%' AS line FROM tally WHERE pct >= 51")
def _(spark, sf):
    return vote.report_lines(_tally(spark, sf)[0])


@_query("sink4_assessment", """, gs AS (SELECT map_id, group_id, count(*) AS n, count(*) FILTER (pct >= 51) AS n_assigned FROM tally GROUP BY 1, 2),
ms AS (SELECT b.map_id, n_bins, n_false, n_scaffolds FROM (SELECT map_id, count(*) AS n_bins FROM kept GROUP BY 1) b JOIN (SELECT map_id, sum(CASE WHEN pct < 51 THEN n_in ELSE 0 END)::BIGINT AS n_false, count(*) FILTER (pct >= 51) AS n_scaffolds FROM tally GROUP BY 1) t ON t.map_id = b.map_id)
SELECT map_id, group_id AS part, 0 AS at, '### Chromosome' || group_id || ' ###' AS line FROM gs UNION ALL SELECT map_id, group_id, 1, '#Scaffold' || chr(9) || 'Nodes assigned' || chr(9) || 'Total nodes' || chr(9) || 'Assigned %' FROM gs
UNION ALL SELECT map_id, group_id, 2, scaffold || chr(9) || n_in || chr(9) || n_total || chr(9) || printf('%.2f', pct) || '%' FROM tally
UNION ALL SELECT map_id, group_id, 3, 'Scaffolds with nodes in the group ' || n FROM gs UNION ALL SELECT map_id, group_id, 4, 'Scaffolds assigned to the group ' || n_assigned FROM gs
UNION ALL SELECT map_id, NULL, 5, 'Total nodes ' || n_bins FROM ms UNION ALL SELECT map_id, NULL, 6, 'Properly clustered nodes ' || (n_bins - n_false) FROM ms UNION ALL SELECT map_id, NULL, 7, 'Falsely clustered nodes ' || n_false FROM ms
UNION ALL SELECT map_id, NULL, 8, 'Scaffolds assigned ' || n_scaffolds FROM ms UNION ALL SELECT map_id, NULL, 9, 'Error rate ' || printf('%.2f', round(100.0::DOUBLE * n_false / n_bins, 4)) || '%' FROM ms""")
def _(spark, sf):
    return vote.assessment_lines(*_tally(spark, sf)).drop("by")


@_query("sink7_flat_order", "SELECT map_id, group_id, bin_id, row_number() OVER (PARTITION BY map_id, group_id ORDER BY pos) AS \"at\" FROM placed")
def _(spark, sf):
    flat = emit.flat_order(_given_order(_assigned(spark, sf)))
    return flat.select("map_id", "group_id", "bin_id", F.row_number().over(Window.partitionBy("map_id", "group_id").orderBy("ord", "k")).alias("at"))


@_query("sink8_joined_lines", """, whole AS (SELECT group_id, string_agg(CASE WHEN orientation = '-' THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END, repeat('N', 100) ORDER BY ord) AS s FROM dord GROUP BY 1)
SELECT group_id, line_no, substr(s, (line_no * 50 + 1)::BIGINT, 50) AS line FROM (SELECT group_id, s, unnest(generate_series(0, (length(s) - 1) // 50)) AS line_no FROM whole WHERE length(s) > 0)""")
def _(spark, sf):
    seqs, placed = _dna(spark, sf)
    return emit.join_lines(emit.oriented(placed, seqs))


@_query("sink9_wrap", "SELECT name, line_no, substr(seq, (line_no * 50 + 1)::BIGINT, 50) AS line FROM (SELECT name, seq, unnest(generate_series(0, (length(seq) - 1) // 50)) AS line_no FROM dna WHERE source IS NULL AND length(seq) > 0)")
def _(spark, sf):
    seqs, placed = _dna(spark, sf)
    return emit.leftovers(placed, seqs).select("name", F.posexplode(wrap(F.col("seq"))).alias("line_no", "line"))


@_query("sink10_ticks", f"SELECT map_id, tick, (tick * n // 10) AS \"at\", printf('%.1f Mb', (tick * n // 10) * {RESOLUTION}::DOUBLE / 1e6::DOUBLE) AS label FROM nb, (SELECT unnest(generate_series(0, 10)) AS tick)")
def _(spark, sf):
    return matrix.axis_ticks(_at(spark, sf)[2], RESOLUTION)


@_query("sink10_plot_cells", """, ex AS (SELECT nb.map_id, nb.n * nb.n - count(atp.v) AS zeros FROM nb LEFT JOIN atp ON atp.map_id = nb.map_id GROUP BY nb.map_id, nb.n),
every AS (SELECT map_id, v FROM atp UNION ALL SELECT map_id, 0.0 FROM (SELECT map_id, unnest(generate_series(1, zeros)) FROM ex)),
bd AS (SELECT map_id, quantile_cont(v, 0.01) AS low, quantile_cont(v, 0.98) AS high FROM every GROUP BY 1) SELECT atp.map_id, i, j, round(greatest(low, least(high, v)), 6) AS v FROM atp JOIN bd ON bd.map_id = atp.map_id""")
def _(spark, sf):
    at, _, n_bins = _at(spark, sf)
    at = durable(at)
    bounds = matrix.clip_bounds(at, n_bins).groupBy("map_id").agg(F.min("bound").alias("low"), F.max("bound").alias("high"))
    return matrix.plot_cells(at, bounds).select("map_id", "i", "j", _six("v"))
