"""Cut texts among complete ones, by rule and against texts cut here at known places."""

from __future__ import annotations

import random

import pytest

from bintangle.llm.truncation import by_reason, by_source, find_truncated, scan

CUE = "{}\n00:00:{:02d},100 --> 00:00:{:02d},900\n{}\n\n"
NOUNS, PLACES = ["lamp", "ledger", "violin", "key", "map"], ["mill", "kiln", "depot", "cellar"]


def whole(rng, cues, closing=None, stops=True):
    lines = [f"Who took the {rng.choice(NOUNS)} to the {rng.choice(PLACES)}" + ("?" if stops else "") for _ in range(cues)]
    if closing:
        lines[-1] = closing
    return "".join(CUE.format(k + 1, k, k, x) for k, x in enumerate(lines)).rstrip("\n")


@pytest.mark.parametrize(
    ("text", "state"),
    [
        ("1\n00:00:01,000 --> 00:00:02,000\nHi.\n\n2\n00:00:0", "timing"), ("1\n00:00:01,000 --> 00:00:02,000\nHi.\n\n2", "number"), ("1\n00:00:01,000 --> 00:00:02,000", "timing"), ("1\n00:00:01,000 --> 00:00:02,000\nHi <i", "markup"),
        ("1\n00:00:01,000 --> 00:00:02,000\nHi the�", "bytes"), ("1\n00:00:01,000 --> 00:00:02,000\nHi the ", "space"), ("1\n00:00:01,000 --> 00:00:02,000\nHi...", "mark"), ("1\n00:00:01,000 --> 00:00:02,000\nHi!", "terminated"),
        ("1\n00:00:01,000 --> 00:00:02,000\n♪ La ♪\n", "closed"), ("1\n00:00:01,000 --> 00:00:02,000\nHi—", "dash"), ("1\n00:00:01,000 --> 00:00:02,000\nHi there", "open"), ("", "blank"), (" \n\t", "blank"), ("﻿", "blank"),
        ("1\n00:00:01,000 --> 00:00:02,000\nHi.\n\n2\n00:00:03…", "timing"), ("1\r\n00:00:01,000 --> 00:00:02,000\r\nHi.\r\n", "terminated"), ("1\n00:00:01,000 --> 00:00:02,000\nHi,", "comma"), ("1\n00:00:01,000 --> 00:00:02,000\n-", "opening"),
    ],
)
def test_states(text, state):
    assert scan(text)["state"] == state


def test_open_symbols_of_the_last_cue_only():
    text = "1\n00:00:01,000 --> 00:00:02,000\n[lost (x\n\n2\n00:00:03,000 --> 00:00:04,000\n(a [b] <i>c"
    found = scan(text)
    assert found["open"] == ["(", "<i>"] and dict(found["left_open"]) == {"[": 1, "(": 1}


def test_a_closing_symbol_takes_the_last_of_its_kind():
    head = "1\n00:00:01,000 --> 00:00:02,000\n"
    assert scan(head + "((a) b")["open"] == ["("] and scan(head + "([a) b")["open"] == [] and scan(head + "a) b]")["open"] == []
    assert scan(head + "[" * 50_000 + ")" * 50_000)["open"] == ["["]


def test_plain_quotes_are_on_the_stack():
    head = "1\n00:00:01,000 --> 00:00:02,000\n"
    assert scan(head + 'He said "we went')["open"] == ['"'] and scan(head + 'He said "we" went')["open"] == [] and scan(head + 'a "b" (c "d')["open"] == ['"', "("]
    assert dict(scan(head + '"a\n\n2\n00:00:03,000 --> 00:00:04,000\nb"')["left_open"]) == {'"': 1}


def test_broken_bytes_count_only_where_no_others_are():
    head = "1\n00:00:01,000 --> 00:00:02,000\n"
    assert scan(head + "Hi the��")["state"] == "bytes" and scan(head + "H� th� k�ln�")["state"] == "open"


def test_closing_tags_and_paired_marks_end_a_line():
    head = "1\n00:00:01,000 --> 00:00:02,000\n"
    assert scan(head + "<i>Read by Nebelhorn</i>")["state"] == "closed" and scan(head + "â™ª Row home â™ª")["state"] == "closed"
    assert scan(head + "no we said no")["state"] == "open" and scan(head + "<i>Read by Nebelh")["state"] == "open"


def test_reasons_and_short_limits(spark):
    rng = random.Random(6)
    rows = [(k, whole(rng, 5), "free") for k in range(200)]
    for k in range(200, 230):
        text = whole(rng, 1, "The kiln and the mill and the key of the ledger and the map")[:60]
        rows.append((k, text if text[-1].isalpha() else text[:-1] + "q", "short"))
    rows.append((230, whole(rng, 3, 'They said "the mill'), "free"))
    got = find_truncated(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3))
    reasons = {r.reason: (r.n_texts, r.share) for r in by_reason(got).collect()}
    assert sum(n for n, _ in reasons.values()) == 31 and sum(x for _, x in reasons.values()) == pytest.approx(1, abs=0.001) and reasons["open bracket, quote or tag"][0] == 1
    assert by_reason(got.limit(0)).count() == 0


def test_planted_cuts_are_found(spark):
    rng = random.Random(0)
    rows, cut = [], set()
    for k in range(600):
        text = whole(rng, rng.randint(2, 12), rng.choice([None, None, None, "THE END", "♪ Sleep, little kiln", "Who took the key to the mill...", "Who took the map to the kiln—"]))
        rows.append((k, text + rng.choice(["", "\n", "\n\n"]), "free"))
    for k in range(600, 800):
        text = whole(rng, 10)[:300]
        while text[-1] in "?\n":
            text = whole(rng, 10)[: 300 - 0]
            text = text[:299] + "x" if text[-1] in "?\n" else text
        rows.append((k, text, "limited"))
        cut.add(k)
    for k in range(800, 860):
        text = whole(rng, 6)
        at = rng.randint(len(text) // 2, len(text) - 2)
        while text[at - 1] in "?\n" or text[at - 1 : at + 1].isspace():
            at -= 1
        rows.append((k, text[:at], "Free "))
        cut.add(k)
    for k in range(860, 900):
        rows.append((k, whole(rng, rng.randint(2, 14), stops=False) + "\n", "bare"))
    for k in range(900, 940):
        rows.append((k, whole(rng, rng.randint(2, 14), stops=False), "bare"))
    rows += [(940, None, "free"), (941, "", None), (942, " \n", "free"), (None, whole(rng, 3), None)]
    got = find_truncated(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4))
    found = {r.doc_id for r in got.where("cut IS NOT NULL").collect()}
    texts = {r[0]: r[1] for r in rows}
    assert len(found & cut) >= 0.97 * len(cut), [texts[k][-40:] for k in cut - found]
    assert len(found - cut) <= 0.02 * len(rows), [texts[k][-40:] for k in list(found - cut)[:12]]
    shares = {r.source: (r.n_texts, r.n_cut) for r in by_source(got).collect()}
    assert shares["limited"][0] == 200 and shares["limited"][1] >= 195 and shares["free"][0] == 662 and shares[""] == (2, 0)


def test_empty_and_very_long(spark):
    schema = "doc_id long, text string, source string"
    assert find_truncated(spark.createDataFrame([], schema)).count() == 0
    long = [(1, "a" * 500_000, "s"), (2, "(" * 20_000, "s"), (3, "1\n00:00:01,000 --> 00:00:02,000\n" + "Yes. " * 50_000 + "No.", "s")]
    assert {r.doc_id for r in find_truncated(spark.createDataFrame(long, schema)).where("cut IS NULL").collect()} == {3}
