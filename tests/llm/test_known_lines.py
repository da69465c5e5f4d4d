"""A known closing line is one of many different complete texts, as a share, and no pass for a text at its source's limit."""

from __future__ import annotations

import random

from bintangle.llm.truncation import find_truncated
from tests.llm.test_truncation import whole


def found(spark, rows):
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "doc_id long, text string, source string")
    return {r.doc_id: r.cut for r in find_truncated(df.repartition(4)).collect()}


def test_fragments_do_not_become_known_as_texts_become_more(spark):
    rng = random.Random(3)
    rows = [(whole(rng, 4), "free") for _ in range(100)]
    rows += [(whole(rng, 6, "They carried the ledger"), "free") for _ in range(20)] + [(whole(rng, 6, "They carried the ledger") + "\n", "free") for _ in range(2)]
    rows += [(whole(rng, k + 3, "Synced by Quillmoth"), "free") for k in range(4)] + [(whole(rng, k + 3, "Synced by Quillmoth") + "\n", "free") for k in range(4)]
    rows += [(whole(rng, 6, "Behind the depot we met"), "free")] + [(whole(random.Random(9), 6, "Behind the depot we met") + "\n", "free")] * 3
    got = found(spark, rows)
    assert all(got[k] for k in range(100, 120)) and got[130] == "no terminator"  # repeated texts are no further evidence
    assert all(got[k] is None for k in range(122, 130))


def test_a_limit_still_holds_for_known_lines(spark):
    rng = random.Random(4)
    rows = [(whole(rng, 4), "free") for _ in range(100)] + [(whole(rng, 5, "Synced by the") + "\n", "free") for _ in range(3)]
    rows += [(whole(rng, 5, "Synced by Quillmoth") + "\n", "free") for _ in range(5)]
    ends = [rng.choice(["Synced by Quillmoth", "Synced by Quil"]) for _ in range(30)]
    for end in ends:
        text = whole(rng, 8, end)
        rows.append(("x" * (600 - len(text)) + text, "limited"))
    got = found(spark, rows)
    assert all((got[108 + k] == "limit of the source") if end.endswith("moth") else got[108 + k] for k, end in enumerate(ends))
    assert all(got[k] is None for k in range(103, 108))
