"""Subtitle texts that stop before their end: a structural check by a stack automaton, and baselines counted over all texts.

Every task runs one automaton over each whole text. Its stack holds the open brackets, quotes and tags of the present cue; blank lines end a cue. At the end of the text its state
says what the text stops in: a cue's number or timing line, broken multibyte sequence, tag, bracket, or a line of text, and how that line ends. Some endings decide alone. The others are
compared with baselines over all texts:

* the limits of each source: lengths, in characters or bytes, that clearly too many of its texts have;
* how often the inner cues of each source leave a bracket or tag open, and end without a terminator;
* closing words: how often a word stands last, and how often inside, in closing lines that are surely complete (they end in a terminator or a line break);
* closing lines without a terminator that complete texts have in common (songs, notices, credits): those that enough of the texts that end in them end with a line break.

The stack and the end of the text are judged first: an open bracket, quote or tag is a cut if the cues of the source do not commonly leave it open. A mark (``...``) or dash is a cut if it
follows no closing word. A line without a terminator is cut if its last word never closes, or unless it is known, or the text or its source does without terminators and the last word
is a closing one. The limits come last: of the texts that all this takes to be complete, those at a limit of their source that end in a mark or without a terminator are cut.

Defined cases: null, empty and blank texts are no cases; null sources form one source; sources are compared without outer white space and case; a text without cues is judged by its last line; repeated texts
are judged alike; a null ``doc_id`` is kept; texts of any length are read whole; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bintangle.session import durable, join_dictionary, name_key

#: A length is a limit of a source if at least so many of its texts, and this share of them, have it, and at least ``LIMIT_OPEN`` of those do not end like a complete text.
LIMIT_TEXTS, LIMIT_SHARE, LIMIT_OPEN = 5, 0.01, 0.5
#: Bytes by which a cut may miss a limit in bytes: part of a character left out, or replaced.
LIMIT_SLACK = (-3, 2)
#: Least share of its occurrences in closing lines at which a word is a closing word.
CLOSING_SHARE = 0.1
#: A word of at least so many occurrences and at most this share never closes: after it even a line break ends no text.
NEVER_WORDS, NEVER_SHARE = 20, 0.01
#: Different complete texts that must share a closing line without a terminator, and their least share of all different texts that end in it. The share keeps fragments out that
#: become frequent as texts become more.
KNOWN_LINES, KNOWN_SHARE = 2, 0.2
#: Share of terminated cues below which a text or source does without terminators.
TERMINATED = 0.25
#: Words or lines that are sent to every executor; beyond it they are joined by a shuffle.
WORDS_SENT = 50_000
#: Share of inner cues that may leave a symbol open in a source where an open symbol still counts.
OPEN_SHARE = 0.02

_PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "」": "「", "』": "『", "】": "【", "”": "“", "»": "«"}
_OPENERS = set(_PAIRS.values())
_TOKENS = re.compile(r"\n[ \t]*(?:\n[ \t]*)+|</?[a-zA-Z][^<>\n]{0,40}>|[()\[\]{}（）「」『』【】“”«»\"]")
_TIMING = re.compile(r"\s*\d{1,3}:\d{1,2}:\d{1,2}[,.:]\d{1,3}\s*-+>\s*\d{1,3}:\d{1,2}:\d{1,2}[,.:]\d{1,3}(?:\s.*)?")
_TIMING_PART = re.compile(r"[\d:.,\->\s]+")
_MARK = re.compile(r"\s*(?:\[(?:\.\.\.|…)\]|\.\.\.+|…|â€¦|â\x80¦)$")
_DASH = re.compile(r"\s*[-–—]+$")
_TERMINATED = re.compile(r"[.!?。！？][\"'”»’)\]]*$")
_CLOSED = re.compile(r"[♪♫#\])）」』】”»\"～~}*]$")
_TAG_END = re.compile(r"(?:</?[a-zA-Z][^<>]*>|\{\\[^{}]*\})+$")
_TAGS = re.compile(r"</?[a-zA-Z][^<>]*>|\{\\[^{}]*\}")
_BROKEN = re.compile(r"(?:<[^<>]{0,40}|\{[^{}]{0,40}|&[a-zA-Z#0-9]{0,8}|\\u[0-9a-fA-F]{0,3})$")
_WIDE = re.compile(r"[぀-ヿ㐀-鿿]")
#: Before the words of a closing line: marks, a music note in a wrong encoding, a speaker.
_LEAD = re.compile(r"^(?:[^\w]+|â\S{0,2} |[\w .]{1,20}: )+")
_EDGE = "\"'“”«»„()[]（）「」♪#*-–—.,:;!?¡¿。、！？… \t"
_END = set(".!?。！？…")


def _words(line: str) -> list[str]:
    """Words of a line; of scripts written without spaces, its pairs of characters."""
    line = _TAGS.sub("", line)
    if _WIDE.search(line):
        line = re.sub(r"\s+", "", line).strip(_EDGE)
        return [line[k : k + 2] for k in range(len(line) - 1)] or [line]
    return [w for w in (x.strip(_EDGE).lower() for x in line.split()) if w]


def _framed(line: str) -> bool:
    """Whether a line begins and ends with the same mark, as songs do; a music note in a wrong encoding has letters among its signs."""
    parts = line.split()
    return len(parts) > 2 and parts[0] == parts[-1] and not all(c.isalnum() or c in "'’-" for c in parts[0])


class _Stack:
    """Open symbols of a cue; a closing symbol takes the last of its kind and all behind it."""

    def __init__(self) -> None:
        self.symbols: list[str] = []
        self.held: dict[str, int] = {}

    def push(self, symbol: str) -> None:
        self.symbols.append(symbol)
        self.held[symbol] = self.held.get(symbol, 0) + 1

    def close(self, symbol: str) -> None:
        if self.held.get(symbol):
            while True:
                last = self.symbols.pop()
                self.held[last] -= 1
                if last == symbol:
                    return

    def kinds(self) -> list[str]:
        return sorted(k for k, n in self.held.items() if n)

    def clear(self) -> None:
        self.symbols.clear()
        self.held.clear()


def _walk(text: str) -> tuple[int, int, dict[str, int], _Stack, int]:
    """Inner cues, those that end in a terminator, symbols left open in them by kind, the stack at the end, and where the last cue starts."""
    cues = ended = start = 0
    left_open: dict[str, int] = {}
    stack = _Stack()
    for m in _TOKENS.finditer(text):
        token = m.group()
        first = token[0]
        if first == "\n":
            cues += 1
            ended += text[m.start() - 1] in _END if m.start() else 0
            for kind in stack.kinds():
                left_open[kind] = left_open.get(kind, 0) + 1
            stack.clear()
            start = m.end()
        elif first == "<":
            name = token.strip("</>").split(" ")[0].lower()
            if token[1] != "/":
                stack.push(f"<{name}>")
            else:
                stack.close(f"<{name}>")
        elif first in _OPENERS or (first == '"' and not stack.held.get(first)):  # a plain quote closes one that is open
            stack.push(first)
        else:
            stack.close(_PAIRS.get(first, first))
    return cues, ended, left_open, stack, start


def scan(text: str) -> dict:
    """What the automaton finds; ``state`` is how the text ends, and ``cut`` is set if that decides alone."""
    plain = text.replace("\r\n", "\n").replace("\r", "\n")
    body = plain.strip("\ufeff").rstrip("\n")
    found = {"n_chars": len(text), "n_bytes": len(text.encode("utf-8", "surrogatepass")), "broken_line": len(body) < len(plain.strip("\ufeff")), "digest": int.from_bytes(blake2b(body.strip().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True), "state": "blank", "cut": None, "word": None, "line": None, "inner": [], "open": [], "cues": 0, "ended": 0, "left_open": []}
    if not body.strip():
        return found
    cues, ended, left_open, stack, start = _walk(body)
    found |= {"cues": cues, "ended": ended, "left_open": list(left_open.items()), "open": stack.kinds()}
    lines = body[start:].split("\n")
    at = 0
    unmarked = _MARK.sub("", lines[-1])
    if lines[0].strip().isdigit() and (start or len(lines) > 1):
        at = 1
    if at == len(lines) or (len(lines) == 1 and start and unmarked.strip().isdigit()):
        return found | {"state": "number", "cut": "cue number"}
    if _TIMING.fullmatch(lines[at]):
        at += 1
        if at == len(lines):
            return found | {"state": "timing", "cut": "timing line"}
    elif at == len(lines) - 1 and (not unmarked.strip() or (_TIMING_PART.fullmatch(unmarked) and (at or ":" in unmarked))):
        return found | {"state": "timing", "cut": "timing line"}
    line = lines[-1]
    if line[-1:] in (" ", "\t") and not found["broken_line"]:
        return found | {"state": "space", "cut": "inside a sentence"}
    if line.endswith("�") and "�" not in plain.rstrip("\n�"):  # in a text of a wrong encoding they stand elsewhere too
        return found | {"state": "bytes", "cut": "broken character"}
    if _BROKEN.search(line.rstrip()) and not found["broken_line"]:
        return found | {"state": "markup", "cut": "broken markup or escape"}
    tail = _TAG_END.sub("", line.rstrip()).rstrip()
    if not tail or tail in {"-", "–", "♪", "#"} or re.fullmatch(r"[-–]?\s*[\w .]{1,24}:", tail):
        return found | {"state": "opening", "cut": "inside a cue"}
    if (m := _MARK.search(tail)) and tail[: m.start()].strip():
        state, base = "mark", tail[: m.start()]
    elif _TERMINATED.search(tail):
        state, base = "terminated", tail
    elif (m := _DASH.search(tail)) and tail[: m.start()].strip():
        state, base = "dash", tail[: m.start()]
    elif _CLOSED.search(tail):
        state, base = "closed", tail
    elif tail[-1] in ",;:、¡¿([{（「“«&":
        return found | {"state": "comma", "cut": "inside a sentence"}
    elif line.rstrip().endswith(">") or _framed(tail):
        state, base = "closed", tail
    else:
        state, base = "open", tail
    words = _words(base)
    return found | {"state": state, "word": words[-1] if words else None, "line": " ".join(_LEAD.sub("", _TAGS.sub("", tail), count=1).lower().split()), "inner": words[:-1]}


_SCANNED = "doc_id bigint, source string, n_chars int, n_bytes int, broken_line boolean, digest bigint, state string, cut string, word string, line string, `inner` array<string>, `open` array<string>, cues int, ended int, left_open array<struct<kind:string,n:int>>"


def scan_texts(documents: DataFrame) -> DataFrame:
    """One row of findings for each text of ``documents`` (``doc_id``, ``text``, ``source``); ``source`` comes out as it is compared."""
    from bintangle.llm.quantiles import _arrow_schema

    schema = _arrow_schema(_SCANNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, source, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                found = scan(text or "")
                found["left_open"] = [{"kind": k, "n": n} for k, n in found["left_open"]]
                rows.append({"doc_id": doc_id, "source": source, **found})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return documents.select(F.col("doc_id").cast("bigint"), F.coalesce(name_key(F.col("source")), F.lit("")).alias("source"), "text").mapInArrow(run, _SCANNED)


def source_limits(scanned: DataFrame) -> DataFrame:
    """``source``, ``limits``: the lengths that too many texts of a source have, in characters (``chars``) and bytes (``bytes``)."""
    total = scanned.groupBy("source").agg(F.count("*").alias("n_source"))
    unfinished = F.col("cut").isNotNull() | (F.col("state").isin("open", "mark", "dash") & ~F.col("broken_line"))
    lengths = scanned.where("state <> 'blank'").select("source", unfinished.alias("unfinished"), F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("n_bytes").alias("length")))).alias("x"))
    counted = lengths.groupBy("source", "x").agg(F.count("*").alias("n"), F.count_if("unfinished").alias("n_open")).join(total, "source")
    often = counted.where((F.col("n") >= LIMIT_TEXTS) & (F.col("n") >= LIMIT_SHARE * F.col("n_source")) & (F.col("n_open") >= LIMIT_OPEN * F.col("n")))
    return often.groupBy("source").agg(F.collect_list("x").alias("limits"))


def source_habits(scanned: DataFrame) -> DataFrame:
    """``source``, share of ``terminated`` inner cues, and the symbols its inner cues commonly leave open (``loose``)."""
    cues = scanned.groupBy("source").agg(F.sum("cues").alias("cues"), F.try_divide(F.sum("ended"), F.sum("cues")).alias("terminated"))
    kinds = scanned.select("source", F.explode("left_open").alias("x")).groupBy("source", "x.kind").agg(F.sum("x.n").alias("n"))
    loose = kinds.join(cues, "source").where(F.col("n") > OPEN_SHARE * F.col("cues")).groupBy("source").agg(F.collect_list("kind").alias("loose"))
    return cues.join(loose, "source", "left").select("source", "terminated", F.coalesce("loose", F.array().cast("array<string>")).alias("loose"))


def closing_words(scanned: DataFrame) -> DataFrame:
    """``word``, its occurrences in surely complete closing lines (``n_word``) and the share of them that stand last (``closing``), of words that close often enough or never."""
    sure = scanned.where("state = 'terminated' OR (broken_line AND state IN ('mark', 'dash', 'open'))")
    last = sure.where("word IS NOT NULL").select("word", F.lit(1).alias("last"))
    inner = sure.select(F.explode("inner").alias("word"), F.lit(0).alias("last"))
    counted = last.union(inner).groupBy("word").agg(F.count("*").alias("n_word"), F.avg("last").alias("closing"))
    return counted.where((F.col("closing") >= CLOSING_SHARE) | ((F.col("n_word") >= NEVER_WORDS) & (F.col("closing") <= NEVER_SHARE)))


def known_lines(scanned: DataFrame) -> DataFrame:
    """Closing lines without a terminator that several different complete texts (``n_line``) have, and a sufficient share of all different texts that end in them."""
    texts = scanned.where("state = 'open'").groupBy("line", "digest").agg(F.max("broken_line").alias("complete"))
    counted = texts.groupBy("line").agg(F.count_if("complete").alias("n_line"), F.count("*").alias("n_ends"))
    return counted.where((F.col("n_line") >= KNOWN_LINES) & (F.col("n_line") >= KNOWN_SHARE * F.col("n_ends"))).select("line", "n_line")


def _at_limit() -> Column:
    low, high = LIMIT_SLACK
    return F.exists(F.coalesce("limits", F.array().cast("array<struct<unit:string,length:int>>")), lambda x: F.when(x.unit == "chars", F.col("n_chars") == x.length).otherwise((F.col("n_bytes") - x.length).between(low, high)))


def find_truncated(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``state`` and ``cut``: why the text is taken to be cut off, null if it is not."""
    scanned = durable(scan_texts(documents))
    df = scanned.select("doc_id", "source", "n_chars", "n_bytes", "broken_line", "state", "cut", "word", "line", "open", "cues", "ended")
    for dictionary, key in ((source_limits(scanned), "source"), (source_habits(scanned), "source"), (closing_words(scanned), "word"), (known_lines(scanned), "line")):
        df = join_dictionary(df, dictionary, key, "left", WORDS_SENT)
    at_limit = _at_limit()
    closing = F.coalesce("closing", F.lit(0.0)) >= CLOSING_SHARE
    never = (F.col("n_word") >= NEVER_WORDS) & (F.col("closing") <= NEVER_SHARE)
    loose = F.size(F.array_except("open", F.coalesce("loose", F.array().cast("array<string>")))) > 0
    free = F.coalesce(F.when(F.col("cues") >= 2, F.col("ended") / F.col("cues")), F.col("terminated"), F.lit(0.0)) < TERMINATED
    unfinished = F.col("state").isin("mark", "dash", "open")
    judged = (
        F.when(F.col("cut").isNotNull(), F.col("cut"))
        .when(loose & ~F.col("broken_line") & ((F.col("state") != "terminated") | F.exists("open", lambda x: x.startswith("<"))), "open bracket, quote or tag")
        .when(F.col("state").isin("mark", "dash") & ~F.col("broken_line") & ~closing, "mark inside a sentence")
        .when((F.col("state") == "open") & never, "inside a sentence")
        .when((F.col("state") == "open") & F.col("n_line").isNull() & ~F.col("broken_line") & ~(free & closing), "no terminator")
        .when(unfinished & at_limit, "limit of the source")
    )
    return df.select("doc_id", "source", "state", judged.alias("cut"))


def by_reason(truncated: DataFrame) -> DataFrame:
    """``reason``, the texts cut off for it, and their share of all that are."""
    counted = truncated.where("cut IS NOT NULL").groupBy(F.col("cut").alias("reason")).agg(F.count("*").alias("n_texts"))
    return counted.join(F.broadcast(counted.agg(F.sum("n_texts").alias("_all")))).select("reason", "n_texts", F.round(F.col("n_texts") / F.col("_all"), 4).alias("share"))


def by_source(truncated: DataFrame) -> DataFrame:
    """``source``, its texts, those cut off, and their share; blank texts count as texts."""
    return truncated.groupBy("source").agg(F.count("*").alias("n_texts"), F.count("cut").alias("n_cut"), F.round(F.count("cut") / F.count("*"), 4).alias("share"))
