"""Rows that fail to parse: one anchored regular expression per file kind, then field-prefix patterns that name the first broken field.

The expressions are generated from a schema of field types. A whole line is tried once against the anchored
expression of its kind; only lines that fail pass through the prefix expressions, one per field, growing, so
that the first prefix that does not match tells the first broken field. All of it is JVM-side ``rlike``: no shuffle,
no Python.

Defined cases: a null line or a line of an unknown kind is unusable (reasons ``null line``, ``unknown kind``); a null
kind is unknown; a line that starts with ``#`` is a comment and comes out in neither table; an empty line has the wrong number of
fields or an empty field; repeated lines come out as often as they go in; extra columns are kept, and a column of the input that has
the name of an output column is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """One field of a line: ``kind`` is ``name``, ``int``, ``number`` or ``number_or_nan``."""

    name: str
    kind: str


#: The three delivered files. An ``ordered`` pair must be strictly ascending.
SCHEMAS: dict[str, tuple[Field, ...]] = {
    "bed": (Field("scaffold", "name"), Field("start", "int"), Field("stop", "int"), Field("bin_id", "int")),
    "bias": (Field("bias", "number_or_nan"),),
    "matrix": (Field("b1", "int"), Field("b2", "int"), Field("val", "number")),
}
ORDERED = {"bed": ("start", "stop")}
INT64_MAX = "9223372036854775807"


def int64_pattern(largest: str = INT64_MAX) -> str:
    """An expression for ASCII digits whose value is at most ``largest``: any leading zeros, then fewer digits, or as many and no greater."""
    alternatives = [f"[0-9]{{1,{len(largest) - 1}}}"]
    for i, digit in enumerate(largest):
        if digit != "0":
            below = "0" if digit == "1" else f"[0-{int(digit) - 1}]"
            alternatives.append(f"{largest[:i]}{below}[0-9]{{{len(largest) - i - 1}}}")
    return f"0*(?:{'|'.join([*alternatives, largest])})"


_NUMBER = r"[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
#: Of each type, its content in a plain field and within quotes.
CONTENT = {
    "name": (r'(?=[^\t" ])[^\t"]*+', r'(?=[^" ]|"")[^"]*+(?:""[^"]*+)*+'),
    "int": (int64_pattern(),) * 2,
    "number": (_NUMBER,) * 2,
    "number_or_nan": (rf"(?:{_NUMBER}|[nN][aA][nN])",) * 2,
}
#: A field of any content with sound quoting; tells a wrong value from broken quoting.
SOUND = r'(?:[^\t"]*+|"[^"]*+(?:""[^"]*+)*+")'


def field_pattern(field: Field) -> str:
    plain, quoted = CONTENT[field.kind]
    return f'(?: *+{plain} *+|" *+{quoted} *+")'


def row_pattern(schema: tuple[Field, ...], fields: int | None = None) -> str:
    """The anchored expression of a whole row; with ``fields``, of the first so many fields and a tab or the end behind them."""
    if fields is None:
        return r"(?s)\A" + r"\t".join(map(field_pattern, schema)) + r"\z"
    return r"(?s)\A" + r"\t".join(map(field_pattern, schema[:fields])) + (r"(?:\t|\z)" if fields else "")


def _sound_pattern(schema: tuple[Field, ...], before: int) -> str:
    """The fields before ``before`` are valid and the next one is soundly quoted."""
    return row_pattern(schema, before).replace(r"(?:\t|\z)", r"\t") + SOUND + r"(?:\t|\z)"


def _value(line: Column, schema: tuple[Field, ...], i: int) -> Column:
    """The content of field ``i`` of a valid row, without quotes and outer spaces, quotes undoubled."""
    every = [f"({field_pattern(f)})" if k == i else field_pattern(f) for k, f in enumerate(schema)]
    got = F.regexp_extract(line, r"(?s)\A" + r"\t".join(every) + r"\z", 1)
    inner = F.when(got.startswith('"'), F.replace(F.substr(got, F.lit(2), F.length(got) - 2), F.lit('""'), F.lit('"'))).otherwise(got)
    return F.trim(inner)


def classify(lines: DataFrame, schemas: dict[str, tuple[Field, ...]] = SCHEMAS) -> DataFrame:
    """``lines`` (``file_kind``, ``line``, any others) with ``reason`` (null: valid or comment), ``is_comment`` and the typed fields."""
    names = list(dict.fromkeys(f.name for s in schemas.values() for f in s))
    keep = [c for c in lines.columns if c not in {"reason", "is_comment", *names}]
    text = F.regexp_replace("line", r"(?s)\r\z", "")
    df = lines.select(*keep, text.alias("_text"))
    text = F.col("_text")
    reason = F.lit("unknown kind")
    typed = {n: F.lit(None) for n in names}
    for kind, schema in schemas.items():
        mine = F.col("file_kind") == kind
        # the first prefix that fails names the first broken field; these patterns run on failures only
        steps = []
        for i, field in enumerate(schema):
            bad = F.when(~text.rlike(_sound_pattern(schema, i)), f"{field.name}: broken quoting or missing").otherwise(f"{field.name}: no valid {field.kind}")
            steps.append(F.when(~text.rlike(row_pattern(schema, i + 1)), bad))
        broken = F.coalesce(*steps, F.lit("wrong number of fields"))
        fits = text.rlike(row_pattern(schema))
        verdict = F.when(~fits, broken)
        if kind in ORDERED:
            low, high = (next(i for i, f in enumerate(schema) if f.name == x) for x in ORDERED[kind])
            verdict = verdict.when(_value(text, schema, low).try_cast("bigint") >= _value(text, schema, high).try_cast("bigint"), f"{ORDERED[kind][0]} not below {ORDERED[kind][1]}")
        reason = F.when(mine, verdict).otherwise(reason)
        for i, field in enumerate(schema):
            kind_type = {"name": "string", "int": "bigint"}.get(field.kind, "double")
            typed[field.name] = F.when(mine & fits, _value(text, schema, i).try_cast(kind_type)).otherwise(typed[field.name])
    comment = F.coalesce(text.startswith("#"), F.lit(False))
    reason = F.when(text.isNull(), "null line").when(~comment, reason)
    return df.select(*keep, comment.alias("is_comment"), reason.alias("reason"), *[F.when(reason.isNull() & ~comment, c).alias(n) for n, c in typed.items()])


def rejects(lines: DataFrame) -> DataFrame:
    """The unusable lines with the reason of each."""
    return classify(lines).where("reason is not null")


def typed_rows(lines: DataFrame, kind: str) -> DataFrame:
    """The valid rows of one file kind, typed."""
    names = [f.name for f in SCHEMAS[kind]]
    return classify(lines).where((F.col("file_kind") == kind) & F.col("reason").isNull() & ~F.col("is_comment")).select(*[c for c in lines.columns if c not in {"line", *names}], *names)
