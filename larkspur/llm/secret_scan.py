"""Secrets by dictionary-primed zstandard novelty.

Three base kinds (assign, access, hex) are found by rule and always reported. Every other long token
near a sensitive word is a candidate. Its novelty is the marginal number of compressed bytes: the code
around it is compressed with and without the token, by zstandard primed with a dictionary of the
identifiers that stand around candidates, and of the words that candidates are made of, in all documents
and of the text around this one. Ordinary
names repeat what the dictionary and the surroundings hold and cost little; random keys cost about
their entropy. Candidates that cost enough bytes, and enough for each character, are reported. So that
no secret vouches for itself, candidates, base spans and tokens equal to the measured one are blanked
out of the surroundings, in the dictionary as in the measure, and copies of one surrounding text count once.

The identifiers are counted over all documents by the digests of the surroundings they stand in, distinct
ones first by partial aggregates; the dictionary is the most frequent ones up to `dictionary_bytes`,
which bounds it whatever the input. Texts are read once and never shuffled: candidates are written with
the few code points around them, measured from that table, and the table is deleted.

Spans are in code points. Null and empty texts have no spans, an empty table gives an empty result, equal
rows get equal spans (ties among identifiers break by their text), and other columns are ignored. Tokens
and texts may be of any length; the time for a text grows with its length times the logarithm of the
number of its spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import Scratch, saved, unused

from .spans import Span, Taken, ordered

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "novel"]
DICTIONARY_BYTES = 32 << 10
#: Code points around a candidate that it is measured against.
AROUND = 160
MIN_BYTES, MIN_PER_CHARACTER = 12, 0.55
MIN_LENGTH = 16

_ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]+)")
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
_HEX_TO_0 = bytes(48 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
#: Words near which a token is worth measuring.
_SENSITIVE = re.compile(r"(?ai:passw|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|bearer|authorization|auth[_ -]?key|client[_ -]?id|signing|encryption|BEGIN [A-Z ]*KEY)")
_SENSITIVE_PARTS = ("passw", "passphrase", "pwd", "secret", "token", "api", "access", "private", "credential", "bearer", "auth", "client", "signing", "encryption", "begin ")
_TOKEN_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=~.-")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=~.-]{%d,}+" % MIN_LENGTH)
_REST = re.compile(r"[A-Za-z0-9+/_=~.-]*+")
#: What follows BEGIN ... KEY in a PEM block: header fields and long base64 runs, with line ends (escaped ones too), quotes and margins between them.
_PEM = re.compile(r"[A-Z\x20]*+-*+(?:(?:\\[nrt]|[\s\"'+,>#*|\\])*+(?:[A-Z][A-Za-z-]*+:\x20[^\r\n\\\"]*+|[A-Za-z0-9+/=]{%d,}+))*+" % MIN_LENGTH)
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]{3,31}")
#: Parts of a candidate that look like words; a random key has next to none.
_PART = re.compile(r"[A-Za-z]?[a-z]{5,31}")


def base_spans(text: str) -> list[Span]:
    """The base spans: leftmost, not overlapping within a kind, without those that are too short."""
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"0" * 32 in text.encode().translate(_HEX_TO_0):
        out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return ordered(out, KINDS)


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Long tokens of mixed characters near a sensitive word that meet no base span.

    The window around a word, with the lines of a PEM block that it opens, is what a token must touch;
    the token is taken whole, however far it reaches.
    """
    low = text.lower()
    if not any(p in low for p in _SENSITIVE_PARTS):
        return []
    taken = Taken(base)
    out: list[tuple[int, int]] = []
    done = 0
    for word in _SENSITIVE.finditer(text):
        first, last = max(done, word.start() - AROUND // 2), min(len(text), word.end() + AROUND)
        if word[0][:5].upper() == "BEGIN":
            last = max(last, _PEM.match(text, word.end()).end())
        while first > done and text[first - 1] in _TOKEN_CHARACTERS:
            first -= 1
        if last > first and text[last - 1] in _TOKEN_CHARACTERS:
            last = _REST.match(text, last).end()
        for m in _TOKEN.finditer(text, first, last):
            done = max(done, m.end())
            token = m[0]
            kinds = any(c.isdigit() for c in token) + any(c.islower() for c in token) + any(c.isupper() for c in token)
            if kinds >= 2 and "@" not in (text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]) and taken.free(*m.span()):
                out.append(m.span())
    return out


def blanked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with blanks in place of the spans."""
    out, done = [], 0
    for a, b in sorted(spans):
        if b > done:
            a = max(a, done)
            out += [text[done:a], " " * (b - a)]
            done = b
    return "".join([*out, text[done:]])


def measured(text: str, base: list[Span]) -> Iterator[tuple[int, int, str, str]]:
    """The candidates, each with the text before and after it, in which no secret is left."""
    spans = candidates(text, base)
    bare = blanked(text, [*spans, *((a, b) for _, a, b in base)]) if spans else ""
    for a, b in spans:
        token, blank = text[a:b], " " * (b - a)
        # A token's length more, so that an equal one at the edge is whole.
        before = bare[max(0, a - AROUND - len(token)) : a].replace(token, blank)[-AROUND:]
        yield a, b, before, bare[b : b + AROUND + len(token)].replace(token, blank)[:AROUND]


class Novelty:
    """Marginal compressed bytes under a dictionary."""

    def __init__(self, dictionary: bytes, level: int = 12):
        import zstandard

        self.zstandard, self.level, self.dictionary = zstandard, level, dictionary

    def cost(self, before: str, token: str, after: str) -> int:
        """How many more compressed bytes the text around has with the token than without it."""
        head, tail = before.encode(), after.encode()
        primed = self.zstandard.ZstdCompressionDict(self.dictionary + b"\n" + head + tail, dict_type=self.zstandard.DICT_TYPE_RAWCONTENT)
        press = self.zstandard.ZstdCompressor(level=self.level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(press.compress(head + token.encode() + tail)) - len(press.compress(head + tail))

    def novel(self, before: str, token: str, after: str) -> bool:
        cost = self.cost(before, token, after)
        return cost >= MIN_BYTES and cost >= MIN_PER_CHARACTER * len(token)


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_LOOSE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("token", pa.string()), ("before", pa.string()), ("after", pa.string())]))
_SPAN = "array<struct<kind:string,start:long,end:long>>"


def spotted(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, base and loose: the candidates with what stands around them."""
    names = [doc_id, unused("base", [doc_id]), unused("loose", [doc_id])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, looses = [], []
            for x in batch.column(1):
                t = x.as_py() or ""
                base = base_spans(t)
                bases.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
                looses.append([{"start": a, "end": b, "token": t[a:b], "before": before, "after": after} for a, b, before, after in measured(t, base)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, _SPANS), pa.array(looses, _LOOSE)], names)

    own = documents.select(F.col(doc_id), F.col(text).cast("string"))
    return own.mapInArrow(run, f"`{doc_id}` {own.schema[0].dataType.simpleString()}, {names[1]} {_SPAN}, {names[2]} array<struct<start:long,end:long,token:string,before:string,after:string>>")


def dictionary(candidates: DataFrame, size: int = DICTIONARY_BYTES) -> bytes:
    """The identifiers around all candidates, the most frequent last, where zstandard reaches them at the least cost."""
    loose = candidates.columns[2]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs: set[tuple[str, bytes]] = set()
            for found in batch.column(0).to_pylist():
                for s in found:
                    at = hashlib.md5(f"{s['before']}\0{s['after']}".encode()).digest()
                    pairs.update((word, at) for word in (*_IDENTIFIER.findall(s["before"]), *_IDENTIFIER.findall(s["after"]), *_PART.findall(s["token"])))
            words, places = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(places, pa.binary())], ["word", "place"])

    words = candidates.select(loose).where(F.size(loose) > 0).mapInArrow(seen, "word string, place binary").distinct().groupBy("word").agg(F.count("*").alias("n"))
    top = words.where(F.col("n") > 1).orderBy(F.desc("n"), "word").limit(size // 5).collect()
    out, room = [], size
    for r in top:
        room -= len(r["word"]) + 1
        if room < 0:
            break
        out.append(r["word"])
    return " ".join(reversed(out)).encode()


def find(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end)."""
    with Scratch(documents.sparkSession) as scratch:
        candidates = scratch.save(spotted(documents, doc_id, text))
        return saved(_judged(candidates, dictionary(candidates, dictionary_bytes)))


def _judged(candidates: DataFrame, primer: bytes) -> DataFrame:
    doc_id = candidates.columns[0]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Novelty(primer)
        for batch in batches:
            bases, alls = batch.column(1).to_pylist(), []
            for base, loose in zip(bases, batch.column(2).to_pylist(), strict=True):
                more = [("novel", s["start"], s["end"]) for s in loose if measure.novel(s["before"], s["token"], s["after"])]
                spans = ordered([*((s["kind"], s["start"], s["end"]) for s in base), *more], KINDS)
                alls.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, _SPANS), pa.array(alls, _SPANS)], [doc_id, "base", "spans"])

    return candidates.mapInArrow(judged, f"`{doc_id}` {candidates.schema[0].dataType.simpleString()}, base {_SPAN}, spans {_SPAN}")
