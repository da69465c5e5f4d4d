"""What problem 3 gives out: typed rows of all three kinds, and every unusable line with its reason."""

from __future__ import annotations

import math

from bintangle.plans import problems


def test_typed_rows_of_every_kind_and_reasons(spark, tmp_path):
    lines = [("bed", '"a""b "\t 1\t"2"\t3\r'), ("bed", "s\t5\t5\t1"), ("bed", "s\t1\tx\t1"), ("bias", "NaN"), ("bias", '" 2.5e1 "'), ("bias", "x"), ("matrix", "1\t2\t3.5"), ("matrix", "1\t2"), ("bias", "#x"), (None, "1"), ("bed", None)]
    df = spark.createDataFrame([(k, "d", *x) for k, x in enumerate(lines)], "line_id long, delivery string, file_kind string, line string")
    df.write.parquet(str(tmp_path / "raw_lines.parquet"))
    got = lambda name: {r.line_id: tuple(r)[1:] for r in problems.QUERIES[name](spark, str(tmp_path)).collect()}
    bias, reasons = got("p3_bias"), {k: x[0] for k, x in got("p3_unusable").items()}
    assert got("p3_bed") == {0: ('a"b', 1, 2, 3)} and got("p3_typed") == {6: (1, 2, 3.5)}
    assert set(bias) == {3, 4} and math.isnan(bias[3][0]) and bias[4] == (25.0,)
    assert reasons.pop(7) in ("val: broken quoting or missing", "val: no valid number", "b2: no valid int")
    assert reasons == {1: "start not below stop", 2: "stop: no valid int", 5: "bias: no valid number_or_nan", 9: "unknown kind", 10: "null line"}
    assert set(got("p3_unusable")) == set(got("p3_found"))
