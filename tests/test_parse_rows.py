"""Row validation against a parser written from the rules, on drawn lines and on edge cases."""

from __future__ import annotations

import random
import re

import pytest

from bintangle.operators.parse_rows import SCHEMAS, classify, int64_pattern, rejects, typed_rows

NUMBER = re.compile(r"[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?\Z")


def fields(line):
    """The contents of a line's fields, None if the quoting is broken."""
    out, at = [], 0
    while True:
        if line[at : at + 1] == '"':
            end, text = at + 1, ""
            while True:
                close = line.find('"', end)
                if close < 0:
                    return None
                text += line[end:close]
                if line[close + 1 : close + 2] == '"':
                    text, end = text + '"', close + 2
                    continue
                break
            at = close + 1
            if at < len(line) and line[at] != "\t":
                return None
            out.append(text)
        else:
            end = line.find("\t", at)
            end = len(line) if end < 0 else end
            if '"' in line[at:end]:
                return None
            out.append(line[at:end])
            at = end
        if at >= len(line):
            return [x.strip(" ") for x in out]
        at += 1


def valid(kind, line):
    got = fields(line[:-1] if line.endswith("\r") else line)
    schema = SCHEMAS[kind]
    if got is None or len(got) != len(schema):
        return False
    for field, x in zip(schema, got, strict=True):
        whole = bool(re.fullmatch("[0-9]+", x, re.A)) and int(x) < 2**63
        number = bool(NUMBER.match(x))
        if not {"name": x != "", "int": whole, "number": number, "number_or_nan": number or x.lower() == "nan"}[field.kind]:
            return False
    return kind != "bed" or int(got[1]) < int(got[2])


PIECES = ["1", "22", "007", "9223372036854775807", "9223372036854775808", "1.5", "1.", ".5", "2e3", "2e", "-1", "nan", "NaN", "s1", '"', '""', '"4"', '"s\t1"', '"a""b"', " ", "  3 ", "\t", "\t", "\t", "\r", "#", "\\", "", "١", "x" * 30]


def drawn(seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice(list(SCHEMAS)), "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 8)))) for _ in range(n)]
    plain = ["1", "22", '"22"', " 5 ", '" 7 "', "9223372036854775807", "9223372036854775808", "0009", "1x", '"1', '1"', ""]
    for kind, schema in SCHEMAS.items():
        rows += [(kind, "\t".join(rng.choice([*plain, "1.5", "nan", "s"]) for _ in schema) + rng.choice(["", "", "\r"])) for _ in range(n)]
    return rows


def test_same_verdict_as_the_rules(spark):
    rows = drawn(1, 600)
    df = spark.createDataFrame([(k, kind, line) for k, (kind, line) in enumerate(rows)], "line_id long, file_kind string, line string")
    found = {r.line_id for r in rejects(df).collect()}
    expected = {k for k, (kind, line) in enumerate(rows) if not line.startswith("#") and not valid(kind, line)}
    assert {rows[k] for k in found ^ expected} == set()
    assert 0 < len(expected) < len(rows)


def test_typed_values(spark):
    df = spark.createDataFrame([(1, "bed", '"a""b\tc "\t" 1 "\t2\t 3\r', 9), (2, "matrix", "1\t2\t3.5e1", 9), (3, "bias", "NaN", 9)], "line_id int, file_kind string, line string, start int")
    bed = typed_rows(df, "bed").collect()
    assert [(r.scaffold, r.start, r.stop, r.bin_id) for r in bed] == [('a"b\tc', 1, 2, 3)]
    assert [(r.b1, r.b2, r.val) for r in typed_rows(df, "matrix").collect()] == [(1, 2, 35.0)]


def test_reasons(spark):
    lines = [("bed", "s\t5\t5\t1"), ("bed", "s\t1\tx\t1"), ("bed", 's\t1\t"2\t1'), ("matrix", "1\t2"), ("matrix", "1\t2\t3\t4"), ("bias", None), ("other", "1"), (None, "1"), ("bias", "#x"), ("bias", ""), ("bias", "2")]
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(lines)], "line_id int, file_kind string, line string")
    reasons = {r.line_id: r.reason for r in classify(df).collect()}
    assert reasons[0] == "start not below stop" and reasons[1].startswith("stop: no valid") and reasons[2].startswith("stop: broken")
    assert reasons[3].startswith("val:") and reasons[4].startswith("val:") or reasons[4] == "wrong number of fields"
    assert (reasons[5], reasons[6], reasons[7], reasons[8], reasons[10]) == ("null line", "unknown kind", "unknown kind", None, None)
    assert reasons[9] is not None


def test_empty_table_and_very_long_lines(spark):
    schema = "line_id int, file_kind string, line string"
    assert rejects(spark.createDataFrame([], schema)).count() == 0
    long = ["x" * 400_000 + "\t1\t2\t3", '"' + '""' * 200_000 + '"\t1\t2\t3', " " * 300_000, '"' * 300_001, "0" * 300_000]
    df = spark.createDataFrame([(0, "bed", long[0]), (1, "bed", long[1]), (2, "bed", long[2]), (3, "bed", long[3]), (4, "bias", long[4])], schema)
    assert {r.line_id for r in rejects(df).collect()} == {2, 3}


@pytest.mark.parametrize("largest", ["0", "9", "10", "407", "9223372036854775807"])
def test_bounded_integer_pattern(largest):
    p = re.compile(int64_pattern(largest) + r"\Z") if len(largest) > 1 else None
    if p:
        for n in (0, 1, int(largest) - 1, int(largest), int(largest) + 1, int(largest) * 10):
            assert bool(p.match(str(n))) == (n <= int(largest)) and bool(p.match("00" + str(n))) == (n <= int(largest))
