"""Encoding of a corpus with a public byte-level BPE tokenizer, by DuckDB recursive queries in each partition.

A task cuts the texts of a batch at places where no token can span (before white space that follows anything else, around
separators between digits), so that only the distinct pieces have to be looked at. New pieces are split into words by the tokenizer's
pattern, and words between two bytes that stand side by side in no token of the vocabulary; what is left goes to DuckDB: rows (word, position, token) join the merge table, a recursive
query contracts each word's leftmost pair of least rank until no pair is in the table, and an ordered aggregation gives the list of each word. The query
keeps one row for each position, and takes all places of a word's least pair in one turn, from the left, as no contraction of it can make a pair of lower rank; where a vocabulary
has such merges, they are taken one at a time. So words of any length go the same way. The ids of the pieces are then put in the places of the pieces.
There is no shuffle, and a task keeps only pieces it met, dropped at ``KEPT`` bytes.

Defined cases: null and empty texts give an empty list; white space is encoded like other text; strings of special tokens in a text are ordinary text; texts of any length are
encoded whole; other columns pass through unless one is named ``ids``, which is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of pieces and their ids that a worker keeps, and bytes of words that one query contracts.
KEPT, TURN = 48 << 20, 1 << 20
#: Bytes of text that are encoded at once.
SLICE = 8 << 20
#: White space as Unicode has it, for RE2.
_SPACE = "\\x09-\\x0D\\x20\\x85\\xA0\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
#: The pattern of byte-level BPE (fixed value), white space spelt out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CONTRACT = """
WITH RECURSIVE step(word, pos, token) USING KEY (word, pos) AS (
  SELECT word, pos, token FROM symbols
  UNION
  (WITH live AS (SELECT word, pos, token FROM recurring.step WHERE token >= 0 AND word IN (SELECT word FROM step)),
   pairs AS (SELECT word, pos, token, lead(token) OVER w AS next, lead(pos) OVER w AS next_pos FROM live WINDOW w AS (PARTITION BY word ORDER BY pos)),
   ranked AS (SELECT word, pos, next_pos, rank, made, alone FROM pairs p JOIN merges m ON p.token = m.a AND p.next = m.b),
   best AS (SELECT * FROM ranked QUALIFY rank = min(rank) OVER (PARTITION BY word)),
   placed AS (SELECT *, lag(next_pos) OVER w IS NOT DISTINCT FROM pos AS continues, row_number() OVER w AS k FROM best WINDOW w AS (PARTITION BY word ORDER BY pos)),
   runs AS (SELECT *, max(CASE WHEN NOT continues THEN k END) OVER (PARTITION BY word ORDER BY pos) AS head FROM placed)
   SELECT word, unnest([pos, next_pos]), unnest([made, -1]) FROM runs WHERE (k - head) % 2 = 0 AND (k = 1 OR NOT alone))
)
SELECT word, list(token ORDER BY pos) AS ids FROM step WHERE token >= 0 GROUP BY word ORDER BY word
"""


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def merge_table(vocab: dict[str, int], pairs: list[tuple[str, str]]) -> pa.Table:
    """``a``, ``b``, ``rank``, ``made`` of each merge; ``alone``: what it makes stands in a merge of lower rank, so its places must be contracted one at a time."""
    least: dict[str, int] = {}
    for rank, pair in reversed(list(enumerate(pairs))):
        least |= dict.fromkeys(pair, rank)
    alone = [least.get(a + b, len(pairs)) < rank for rank, (a, b) in enumerate(pairs)]
    return pa.table({"a": [vocab[a] for a, _ in pairs], "b": [vocab[b] for _, b in pairs], "rank": range(len(pairs)), "made": [vocab[a + b] for a, b in pairs], "alone": alone})


class Encoder:
    """The merge table in DuckDB, and the pieces met so far."""

    def __init__(self, tokenizer: str) -> None:
        import duckdb
        import regex

        with open(tokenizer, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, symbols = model["vocab"], byte_symbols()
        self.byte_ids = np.array([vocab[c] for c in symbols], np.int64)
        byte_of = {c: b for b, c in enumerate(symbols)}
        self.beside = np.zeros((256, 256), bool)
        for token in vocab:
            known = [byte_of[c] for c in token if c in byte_of]
            self.beside[known[:-1], known[1:]] = True
        merges = merge_table(vocab, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.execute("SET preserve_insertion_order = false")
        self.db.register("merges_in", merges)
        self.db.execute("CREATE TABLE merges AS SELECT a::INTEGER AS a, b::INTEGER AS b, rank::INTEGER AS rank, made::INTEGER AS made, alone FROM merges_in")
        self.db.unregister("merges_in")
        self.words = regex.compile(_python_pattern())
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, list[int]] = {}
        self.pieces: dict[str, int] = {}
        self.lists: list[list[int]] = []
        self.held = 0

    def _contract(self, words: list[bytes]) -> None:
        """Ids of each word, one query."""
        sizes = np.array([len(w) for w in words])
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        cut = np.r_[True, ~self.beside[flat[:-1], flat[1:]]]
        cut[starts] = True
        part = np.cumsum(cut) - 1
        pos = np.arange(len(flat)) - np.flatnonzero(cut)[part]
        self.db.register("symbols", pa.table({"word": pa.array(part, pa.int32()), "pos": pa.array(pos, pa.int32()), "token": pa.array(self.byte_ids[flat], pa.int32())}))
        ids = self.db.execute(CONTRACT).fetchall()
        self.db.unregister("symbols")
        ends = [*part[starts[1:]].tolist(), len(ids)]
        at = 0
        for word, end in zip(words, ends, strict=True):
            self.known[word.decode("utf-8", "surrogatepass")] = [t for _, ts in ids[at:end] for t in ts]
            at = end

    def _learn(self, words: list[str]) -> None:
        """Ids of new distinct words."""
        chosen, size = [], 0
        for word in words:
            chosen.append(word.encode("utf-8", "surrogatepass"))
            size += len(chosen[-1])
            if size >= TURN:
                self._contract(chosen)
                chosen, size = [], 0
        if chosen:
            self._contract(chosen)

    def _split(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Pieces of all texts in one array, and where each text's pieces begin and end. Splitting at these places never changes a token."""
        mark = next((m for m in map(chr, (0, 1, 2, 3, 4, 5, 6, 7, 8, 14, 15, 16, 0xE000, 0xF8FF, 0x10FFFF)) if not pc.any(pc.match_substring(texts, m)).as_py()), None)
        if mark is None:
            return texts, np.arange(len(texts) + 1)
        cut = pc.replace_substring_regex(texts, f"([^{_SPACE}])([{_SPACE}])", f"\\1{mark}\\2")
        cut = pc.replace_substring_regex(cut, "([0-9])([:,.])([0-9])", f"\\1{mark}\\2{mark}\\3")
        parts = pc.split_pattern(cut, mark)
        return parts.values, parts.offsets.to_numpy()

    def encode(self, texts: pa.Array) -> pa.Array:
        """Lists of ids; no nulls in ``texts``."""
        if self.held > KEPT:
            self._forget()
        pieces, bounds = self._split(texts)
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [p for p in distinct if p not in self.pieces]
        split = [self.words.findall(p) for p in new]
        self._learn(sorted({w for ws in split for w in ws if w not in self.known}))
        for piece, ws in zip(new, split, strict=True):
            self.pieces[piece] = len(self.lists)
            self.lists.append([i for w in ws for i in self.known[w]])
            self.held += 100 + 2 * len(piece) + 8 * len(self.lists[-1])  # its text, its words and its ids
        lists = [self.lists[self.pieces[p]] for p in distinct]
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        at = coded.indices.to_numpy(zero_copy_only=False)
        size_at = sizes[at] if len(at) else np.empty(0, np.int64)
        ends = np.cumsum(size_at)
        ids = flat[np.arange(int(size_at.sum())) - np.repeat(ends - size_at, size_at) + np.repeat(starts[at] if len(at) else size_at, size_at)]
        offsets = np.r_[0, ends][bounds]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


def _python_pattern() -> str:
    space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    return PATTERN.replace(r"\S", f"[^{space}]").replace(r"[^\s", f"[^{space}").replace(r"\s", f"[{space}]")


#: One encoder for each tokenizer in a Python worker, kept from task to task; it only remembers what it would compute again.
_ENCODERS: dict[str, Encoder] = {}


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive parts of about ``SLICE`` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        limit = (ends[start - 1] if start else 0) + SLICE
        end = max(start + 1, int(np.searchsorted(ends, limit, "right")))
        yield texts[start:end]
        start = end


def encode_column(df: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` with ``ids``, the tokens of ``text``; ``tokenizer`` is the path of a byte-level BPE file that every worker can read."""
    kept = [c for c in df.columns if c not in {text, "ids"}]
    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept], "ids array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if tokenizer not in _ENCODERS:
                _ENCODERS[tokenizer] = Encoder(tokenizer)
            texts = batch.column(batch.num_columns - 1).fill_null("")
            lists = [_ENCODERS[tokenizer].encode(part) for part in _slices(texts)] or [pa.array([], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.concat_arrays(lists)], names=[*kept, "ids"])

    return df.select(*kept, F.col(text).alias("_text")).mapInArrow(run, ddl)


def token_bytes(tokenizer: str = TOKENIZER) -> list[str]:
    """The bytes of each token by id, hexadecimal; empty for ids that stand for no bytes."""
    with open(tokenizer, encoding="utf-8") as file:
        vocab = json.load(file)["model"]["vocab"]
    byte_of = {c: b for b, c in enumerate(byte_symbols())}
    held = [""] * (max(vocab.values()) + 1)
    for token, k in vocab.items():
        held[k] = bytes(byte_of[c] for c in token).hex() if all(c in byte_of for c in token) else ""
    return held


def decode_column(df: DataFrame, ids: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` with ``text`` in the place of ``ids``: the bytes of the tokens put together in order, within each row, JVM-side. The table of tokens is one constant of the size of the vocabulary.

    Null or no ids give the empty text; an id that stands for no bytes is an error, and so are bytes that are no UTF-8.
    """
    tokens = F.split(F.lit(",".join(token_bytes(tokenizer))), ",")
    known = lambda k: F.coalesce(F.nullif(F.get(tokens, k), F.lit("")), F.raise_error(F.concat(F.lit("no token "), F.coalesce(k.cast("string"), F.lit("null")))).cast("string"))
    joined = F.array_join(F.transform(F.coalesce(ids, F.array().cast("array<int>")), known), "")
    return df.select(*[c for c in df.columns if c not in {"text", ids}], F.decode(F.unhex(joined), "UTF-8").alias("text"))
