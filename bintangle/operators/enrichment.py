"""Breakpoint statistics along a map: rank-prefix overlap, its hypergeometric tail, half-window contrast, breakpoints.

Everything is relational and sparse: the overlap counts non-zero cells and adds the zeros that a dense rank would hold in closed form; the tail is
summed within its row, each term from the one before; windows run within each map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bintangle.functions.special import log_factorial


def rank_overlap(ranked: DataFrame, n_bins: DataFrame, start: int = 0) -> DataFrame:
    """Of each row i > start: how many of its first i - start ranked columns lie in [start, i].

    ``ranked``: ``map_id``, ``i``, ``j``, ``k`` by place, non-zero cells only; ``n_bins``: ``map_id``, ``n``. Result: ``map_id``, ``i``, ``c``, ``x``.
    """
    rows = n_bins.select("map_id", "n", F.explode(F.expr(f"if(n > {start + 1}, sequence({start + 1}L, n - 1), cast(array() as array<bigint>))")).alias("i"))
    c = F.col("i") - start
    inside = F.col("j").between(F.lit(start), F.col("i"))
    counts = ranked.groupBy("map_id", "i").agg(F.count("*").alias("filled"), F.count_if(inside & (F.col("k") < c)).alias("hit"), F.count_if(inside).alias("filled_in"), F.count_if(F.col("j") > F.col("i")).alias("filled_above"))
    df = rows.join(counts, ["map_id", "i"], "left").fillna(0, ["filled", "hit", "filled_in", "filled_above"]).withColumn("c", c)
    zeros_above, zeros_in = F.col("n") - 1 - F.col("i") - F.col("filled_above"), c + 1 - F.col("filled_in")
    more = F.least(F.greatest(F.col("c") - F.col("filled") - zeros_above, F.lit(0)), zeros_in)
    return df.select("map_id", "i", "n", "c", (F.col("hit") + more).cast("bigint").alias("x"))


def hypergeometric_tail(df: DataFrame, x: str, population: str, successes: str, draws: str) -> DataFrame:
    """``df`` with ``p`` = P(X >= x). P is 1 where x is at or below the least possible value, 0 above the greatest, and NaN where draws or successes exceed the population.

    The first term comes from log-factorials, the others from the ratio of neighbours, as multiples of the first. A first term beyond the range of doubles and below the mean leaves nothing out: P is 1.
    """
    X, M, n, N = (F.col(c) for c in (x, population, successes, draws))
    least, most = F.greatest(F.lit(0), n + N - M), F.least(n, N)
    first = log_factorial(n) + log_factorial(M - n) - log_factorial(M) + log_factorial(N) + log_factorial(M - N) - log_factorial(X) - log_factorial(n - X) - log_factorial(N - X) - log_factorial(M - n - N + X)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    a, b, rest = (F.col(c) for c in ("_n", "_draws", "_rest"))

    def add(acc: Column, k: Column) -> Column:
        term = acc.term * ((a - k) * (b - k) / ((k + 1) * (rest + k + 1)))
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.when(X < most, F.sequence(X.cast("double").cast("bigint"), (most - 1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    double = lambda c: c.cast("double")
    ready = df.withColumns({"_n": double(n), "_draws": double(N), "_rest": double(M - n - N), "_first": F.when((X > least) & (X <= most) & (n <= M) & (N <= M), first)})
    relative = F.aggregate(F.transform(steps, double), start, add)["sum"]
    tail = F.when((F.col("_first") < -650) & (double(X) < double(n) * double(N) / double(M)), 1.0).otherwise(F.least(F.exp(F.col("_first")) * relative, F.lit(1.0)))
    p = F.when((n > M) | (N > M), F.lit(float("nan"))).when(X <= least, 1.0).when(X > most, 0.0).otherwise(tail)
    return ready.withColumn("p", p).drop("_n", "_draws", "_rest", "_first")


def significant(p_values: DataFrame, psig: float = 0.05, nan_counts: bool = True) -> DataFrame:
    """``flag``: 1 where p < psig. NaN counts as significant in the cutting pass and not in the denoising pass."""
    return p_values.withColumn("flag", F.when(F.isnan("p"), F.lit(int(nan_counts))).when(F.col("p") < psig, 1).otherwise(0))


def half_window_contrast(flags: DataFrame, width: int) -> DataFrame:
    """``contrast`` at i: flags of [i, i + width) minus those of [i + width, i + 2 width); 0 where the right half is ragged."""
    w = Window.partitionBy("map_id").orderBy("i")
    left, right = F.sum("flag").over(w.rowsBetween(0, width - 1)), F.sum("flag").over(w.rowsBetween(width, 2 * width - 1))
    whole = F.count("flag").over(w.rowsBetween(width, 2 * width - 1)) == width
    return flags.withColumn("contrast", F.when(whole, left - right).otherwise(0))


def leftmost_best(contrasts: DataFrame) -> DataFrame:
    """``map_id``, ``best``, ``at``: the greatest contrast and its first place."""
    return contrasts.groupBy("map_id").agg(F.max("contrast").alias("best"), F.max_by("i", F.struct("contrast", -F.col("i"))).alias("at"))


def first_breakpoint(flags: DataFrame, width: int) -> DataFrame:
    """``map_id``, ``cut``: the first place with ``width`` set flags just before it and ``width`` unset ones from it on; null if there is none."""
    full = half_window_contrast(flags, width).where(F.col("contrast") == width)
    return flags.select("map_id").distinct().join(full.groupBy("map_id").agg((F.min("i") + width).alias("cut")), "map_id", "left")


def state_switch(states: DataFrame, width: int = 10) -> DataFrame:
    """``map_id``, ``at``: the first of ``width`` consecutive places that all differ from the state most of the first ``width`` places have; null if there are none.

    ``states``: ``map_id``, ``pos``, ``state`` (0 or 1). Ties among the first places count as state 0.
    """
    w = Window.partitionBy("map_id").orderBy("pos")
    base = states.where(F.col("pos") < width).groupBy("map_id").agg(F.when(F.sum("state") * 2 > F.count("*"), 1).otherwise(0).alias("base"))
    marked = states.join(base, "map_id").withColumn("off", (F.col("state") != F.col("base")).cast("int")).withColumn("n", F.count("*").over(Window.partitionBy("map_id")))
    run = marked.withColumn("run", F.sum("off").over(w.rowsBetween(0, width - 1))).where((F.col("run") == width) & (F.col("pos") < F.col("n") - width))
    return base.select("map_id").join(run.groupBy("map_id").agg(F.min("pos").alias("at")), "map_id", "left")


def community_changes(partition: DataFrame) -> DataFrame:
    """``map_id``, ``cut``: places where the community differs from the one before (``map_id``, ``pos``, ``community``)."""
    before = F.lag("community").over(Window.partitionBy("map_id").orderBy("pos"))
    return partition.withColumn("before", before).where("before <> community").select("map_id", F.col("pos").alias("cut"))
