"""Ids against the tokenizer library itself, and a round trip."""

from __future__ import annotations

import random

import pytest

from bintangle.llm import encode
from bintangle.llm.encode import TOKENIZER, encode_column

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    "", " ", "\n\n\n x", "a  b   c", "it's WE'LL 'tis", "00:01:15,971 --> 00:01:19,072\r\n\r\nHi!\r\n", "1,234.5:6", "♪ la ♪", "嵐のあと、誰かがバイオリンを埋めた。", "Почему Уркавикур", "x" * 3000, "=" * 20001, "".join(random.Random(1).choices("abceeiionrst", k=4000)), "嵐のあと誰かがバイオリンを埋めた" * 300, "ab" * 700, "�\x00\x01 \x02",
    "<|endoftext|> text", "  x 　y ", "🙂🙃 👩‍👩‍👧", "é" * 100, "\t\ttab\t", "trailing   ", "½²Ⅷ٣", " ' s '", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaab", "\x1c\x1d\x85z", "".join(map(chr, range(9))) + "".join(map(chr, (14, 15, 16, 0xE000, 0xF8FF, 0x10FFFF))) + " mark less",
]


def library(texts):
    t = tokenizers.Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    return t, [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("seed", [8, 48, 400])
def test_same_ids_as_the_library(spark, seed):
    rng = random.Random(seed)
    drawn = ["".join(rng.choice("ab eE'’0:,.\n\r\t-é嵐♪Я  ") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    texts = TEXTS + drawn
    t, expected = library(texts)
    df = spark.createDataFrame([(k, x, "extra") for k, x in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r.ids for r in encode_column(df).collect()}
    assert [got[k] for k in range(len(texts))] == expected
    assert all(t.decode(got[k], skip_special_tokens=False) == x for k, x in enumerate(texts))


def test_nulls_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "hi"), (4, "hi"), (4, "hi")], "doc_id long, text string")
    rows = encode_column(df).collect()
    hi = library(["hi"])[1][0]
    assert sorted(((r.doc_id, r.ids) for r in rows), key=str) == sorted([(1, []), (2, []), (None, hi), (4, hi), (4, hi)], key=str)
    assert encode_column(df.limit(0)).count() == 0


def test_slices_and_forgetting_change_nothing(spark, monkeypatch):
    texts = TEXTS * 3
    encoder = encode.Encoder(TOKENIZER)
    monkeypatch.setattr(encode, "KEPT", 5)
    monkeypatch.setattr(encode, "SLICE", 40)
    import pyarrow as pa

    got = [ids for part in encode._slices(pa.array(texts)) for ids in encoder.encode(part).to_pylist()]
    assert got == library(texts)[1]


def test_merges_that_must_be_taken_one_at_a_time():
    vocab = {x: k for k, x in enumerate(["a", "b", "c", "ab", "bc", "abc", "abca"])}
    table = encode.merge_table(vocab, [("b", "c"), ("abc", "a"), ("a", "bc")])
    assert table.column("alone").to_pylist() == [False, False, True]
    encoder = encode.Encoder(TOKENIZER)
    assert not encoder.db.execute("SELECT bool_or(alone) FROM merges").fetchone()[0]
    encoder.db.execute("DELETE FROM merges")
    encoder.db.register("own", table)
    encoder.db.execute("INSERT INTO merges SELECT a, b, rank, made, alone FROM own")
    import pyarrow as pa

    encoder.db.register("symbols", pa.table({"word": pa.array([0] * 6, pa.int32()), "pos": pa.array(range(6), pa.int32()), "token": pa.array([0, 1, 2, 0, 1, 2], pa.int32())}))
    assert encoder.db.execute(encode.CONTRACT).fetchall() == [(0, [vocab["abca"], vocab["bc"]])]


def test_decoding_gives_the_texts_again(spark):
    texts = [*TEXTS, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in encode.decode_column(encode_column(df)).collect()}
    assert [got[k] for k in range(len(texts))] == [x or "" for x in texts]
    for ids, message in (([60000], "no token 60000"), ([None, -1], "no token"), ([int(encode.Encoder(TOKENIZER).byte_ids[0x80])], "UTF|MALFORMED|malformed")):
        with pytest.raises(Exception, match=message):
            encode.decode_column(spark.createDataFrame([(1, ids)], "k int, ids array<int>")).collect()
    assert encode.decode_column(spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")).collect() == [(1, ""), (2, "")]
