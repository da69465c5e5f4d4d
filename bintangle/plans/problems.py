"""Queries of the general data problems: unusable rows (p3) and hot keys (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bintangle.operators.hot_keys import heavy_keys, per_key
from bintangle.operators.parse_rows import classify, rejects, typed_rows
from bintangle.session import load, name_key, scaffold_names

#: Least share of all rows that makes a key a heavy one.
HEAVY_SHARE = 0.02


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects(load(spark, sf_dir, "raw_lines")).select("line_id")


def p3_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid contact rows, typed."""
    return typed_rows(load(spark, sf_dir, "raw_lines"), "matrix").select("line_id", "b1", "b2", "val")


def p3_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid rows of loci, typed."""
    return typed_rows(load(spark, sf_dir, "raw_lines"), "bed").select("line_id", "scaffold", "start", "stop", "bin_id")


def p3_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid biases, typed."""
    return typed_rows(load(spark, sf_dir, "raw_lines"), "bias").select("line_id", "bias")


def p3_unusable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unusable line with its reason: the first broken field, or what else is wrong."""
    return rejects(load(spark, sf_dir, "raw_lines")).select("line_id", "reason")


def p3_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of each delivery and kind are valid, comments, or unusable."""
    df = classify(load(spark, sf_dir, "raw_lines"))
    return df.groupBy("delivery", "file_kind").agg(F.count_if(F.col("reason").isNull() & ~F.col("is_comment")).alias("n_valid"), F.count_if("is_comment").alias("n_comment"), F.count_if(F.col("reason").isNotNull()).alias("n_unusable"))


def _s1_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, sf_dir, "valid_pairs").select(name_key(F.col("s1")).alias("key"), F.col("p1").alias("value"))
    return rows, scaffold_names(load(spark, sf_dir, "scaffold_sizes")).select("key", F.col("scaffold").alias("name"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(*_s1_rows(spark, sf_dir), HEAVY_SHARE).select(F.col("name").alias("scaffold"))


def p4_per_scaffold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, known positions, their mean and extremes of every scaffold."""
    mean = F.when(F.col("n_value") > 0, F.round(F.col("total").cast("double") / F.col("n_value"), 3))
    return per_key(*_s1_rows(spark, sf_dir)).select(F.col("name").alias("scaffold"), "n", "n_value", mean.alias("mean_p1"), F.col("low").alias("min_p1"), F.col("high").alias("max_p1"))


QUERIES = {"p3_found": p3_found, "p3_typed": p3_typed, "p3_bed": p3_bed, "p3_bias": p3_bias, "p3_unusable": p3_unusable, "p3_reasons": p3_reasons, "p4_found": p4_found, "p4_per_scaffold": p4_per_scaffold}

_NUM = r"[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?"
_F = lambda p: f'( *({p}) *|" *({p}) *")'
_NAME = r'([^\t"]*[^\t" ][^\t"]*|"([^"]|"")*([^" ]|"")([^"]|"")*")'
_INT = "[0-9]+"
_TAB = r"\t"
#: The fields of a bed row are told apart by removing all quotes: its numbers hold no tab, so they are the last three.
_LINES = rf"""
lines AS (SELECT line_id, delivery, file_kind, line AS whole, regexp_replace(line, '\r$', '') AS line FROM raw_lines),
parts AS (SELECT *, string_split(replace(line, '"', ''), chr(9)) AS f FROM lines),
judged AS (
  SELECT *, coalesce(line LIKE '#%', false) AS is_comment,
    CASE file_kind
      WHEN 'bed' THEN regexp_full_match(line, '(?s){_NAME}{_TAB}{_F(_INT)}{_TAB}{_F(_INT)}{_TAB}{_F(_INT)}')
        AND TRY_CAST(trim(f[-3]) AS BIGINT) < TRY_CAST(trim(f[-2]) AS BIGINT) AND TRY_CAST(trim(f[-1]) AS BIGINT) IS NOT NULL
      WHEN 'bias' THEN regexp_full_match(line, '{_F(_NUM + "|[nN][aA][nN]")}')
      WHEN 'matrix' THEN regexp_full_match(line, '{_F(_INT)}{_TAB}{_F(_INT)}{_TAB}{_F(_NUM)}')
        AND TRY_CAST(trim(f[1]) AS BIGINT) IS NOT NULL AND TRY_CAST(trim(f[2]) AS BIGINT) IS NOT NULL
    END AS fits
  FROM parts)
"""
_FIELDS = {
    "bed": [("scaffold", "name"), ("start", "int"), ("stop", "int"), ("bin_id", "int")], "bias": [("bias", "number_or_nan")], "matrix": [("b1", "int"), ("b2", "int"), ("val", "number")],
}
_TYPES = {k: x.replace("(", "(?:") for k, x in {"name": r'([^\t"]*[^\t" ][^\t"]*| *"([^"]|"")*([^" ]|"")([^"]|"")*" *)', "int": _F(_INT), "number": _F(_NUM), "number_or_nan": _F(_NUM + "|[nN][aA][nN]")}.items()}


def _reason_sql(kind: str) -> str:
    """The first field whose prefix does not match, found by one expression for each prefix; integers are cast to see whether they fit."""
    fields, steps, fits = _FIELDS[kind], [], []
    for k, (name, type_) in enumerate(fields):
        before = "".join(_TYPES[t] + _TAB for _, t in fields[:k])
        if type_ == "int":
            fits.append(f"TRY_CAST(trim(replace(regexp_extract(line, '(?s)^{before}({_TYPES['int']})({_TAB}|$)', 1), '\"', '')) AS BIGINT) IS NOT NULL")
        valid = " AND ".join([f"regexp_matches(line, '(?s)^{before}{_TYPES[type_]}({_TAB}|$)')", *fits])
        sound = f"regexp_matches(line, '(?s)^{before}([^{_TAB}\"]*|\"[^\"]*(\"\"[^\"]*)*\")({_TAB}|$)')"
        steps.append(f"WHEN NOT ({valid}) THEN CASE WHEN {sound} THEN '{name}: no valid {type_}' ELSE '{name}: broken quoting or missing' END")
    whole = f"regexp_full_match(line, '(?s){_TAB.join(_TYPES[t] for _, t in fields)}')"
    order = "WHEN TRY_CAST(trim(f[-3]) AS BIGINT) >= TRY_CAST(trim(f[-2]) AS BIGINT) THEN 'start not below stop'" if kind == "bed" else ""
    return f"WHEN file_kind = '{kind}' THEN CASE {' '.join(steps)} WHEN NOT {whole} THEN 'wrong number of fields' {order} END"


_KEY = r"lower(regexp_replace({}, '^[\s\x{{0B}}\x{{A0}}]+|[\s\x{{0B}}\x{{A0}}]+$', '', 'g'))"
SQL = {
    "p3_found": f"WITH {_LINES} SELECT line_id FROM judged WHERE NOT is_comment AND NOT coalesce(fits, false)",
    "p3_typed": f"""WITH {_LINES} SELECT line_id, TRY_CAST(trim(f[1]) AS BIGINT) AS b1, TRY_CAST(trim(f[2]) AS BIGINT) AS b2, TRY_CAST(trim(f[3]) AS DOUBLE) AS val
FROM judged WHERE file_kind = 'matrix' AND NOT is_comment AND coalesce(fits, false)""",
    "p3_bed": f"""WITH {_LINES}, named AS (SELECT *, trim(regexp_extract(line, '(?s)^(.*){_TAB}[^{_TAB}]*{_TAB}[^{_TAB}]*{_TAB}[^{_TAB}]*$', 1)) AS s FROM judged WHERE file_kind = 'bed' AND NOT is_comment AND coalesce(fits, false))
SELECT line_id, CASE WHEN s LIKE '"%' THEN trim(replace(substr(s, 2, length(s) - 2), '""', '"')) ELSE s END AS scaffold,
TRY_CAST(trim(f[-3]) AS BIGINT) AS start, TRY_CAST(trim(f[-2]) AS BIGINT) AS stop, TRY_CAST(trim(f[-1]) AS BIGINT) AS bin_id FROM named""",
    "p3_bias": f"""WITH {_LINES} SELECT line_id, TRY_CAST(lower(trim(f[1])) AS DOUBLE) AS bias FROM judged WHERE file_kind = 'bias' AND NOT is_comment AND coalesce(fits, false)""",
    "p3_unusable": f"""WITH {_LINES} SELECT line_id, reason FROM (SELECT line_id, CASE WHEN whole IS NULL THEN 'null line' WHEN is_comment THEN NULL {' '.join(map(_reason_sql, _FIELDS))} ELSE 'unknown kind' END AS reason FROM judged) WHERE reason IS NOT NULL""",
    "p3_reasons": f"""WITH {_LINES} SELECT delivery, file_kind, count(*) FILTER (coalesce(fits, false) AND NOT is_comment) AS n_valid, count(*) FILTER (is_comment) AS n_comment,
count(*) FILTER (NOT is_comment AND NOT coalesce(fits, false)) AS n_unusable FROM judged GROUP BY ALL""",
    "p4_found": f"""WITH names AS (SELECT {_KEY.format('scaffold')} AS key, min(scaffold) AS scaffold FROM scaffold_sizes GROUP BY 1)
SELECT names.scaffold FROM valid_pairs JOIN names ON {_KEY.format('s1')} = names.key GROUP BY 1 HAVING count(*) >= 0.02 * (SELECT count(*) FROM valid_pairs)""",
    "p4_per_scaffold": f"""WITH names AS (SELECT {_KEY.format('scaffold')} AS key, min(scaffold) AS scaffold FROM scaffold_sizes WHERE scaffold IS NOT NULL GROUP BY 1)
SELECT names.scaffold, count(v.k) AS n, count(v.p1) AS n_value, round(avg(v.p1::DOUBLE), 3) AS mean_p1, min(v.p1) AS min_p1, max(v.p1) AS max_p1
FROM names LEFT JOIN (SELECT {_KEY.format('s1')} AS k, p1 FROM valid_pairs) v ON v.k = names.key GROUP BY 1""",
}
