"""Column expressions that Spark lacks: log-gamma, hypergeometric terms, harmonic numbers, reverse complement, line wrap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The usual Lanczos coefficients for g = 7.
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]


def log_factorial(n: Column) -> Column:
    """ln n! for n >= 0, JVM-side, to about 14 digits."""
    x = n.cast("double")
    series = reduce(lambda acc, kc: acc + F.lit(kc[1]) / (x + kc[0] + 1), enumerate(_LANCZOS[1:]), F.lit(_LANCZOS[0]))
    t = x + 7.5
    return F.when(n <= 1, 0.0).otherwise(F.lit(0.9189385332046727) + (x + 0.5) * F.ln(t) - t + F.ln(series))


def harmonic(n: Column) -> Column:
    """H(n), the sum of 1/k up to n: summed for n <= 32, else its asymptotic series (error below 1e-15)."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(n.cast("int"), F.lit(1)), F.lit(32))), F.lit(0.0), lambda acc, k: acc + F.lit(1.0) / k)
    far = F.ln(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4.0))) - 1 / (252 * F.pow(x, F.lit(6.0)))
    return F.when(n <= 0, 0.0).when(n <= 32, small).otherwise(far)


def reverse_complement(sequence: Column) -> Column:
    """The other strand of a DNA text; letters other than ACGTN in either case are an error."""
    bad = F.raise_error(F.lit("a sequence holds letters other than ACGTN"))
    return F.when(sequence.rlike("[^ACGTNacgtn]"), bad.cast("string")).otherwise(F.reverse(F.translate(sequence, "ACGTacgtNn", "TGCAtgcaNn")))


def wrap(text: Column, width: int = 50) -> Column:
    """The lines of a text at a fixed width; none for an empty one."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(width))
    return F.when(F.length(text) > 0, F.transform(starts, lambda p: F.substr(text, p, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def search_space(n: Column) -> Column:
    """Orders and orientations of n things up to full reversal: n! 2^n / 2, as a double."""
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), F.lit(0.5), lambda product, k: product * k * 2)
