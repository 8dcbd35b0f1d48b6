"""Byte-level BPE by a pair occurrence index, and back.

The distinct pre-tokens of a batch of a partition are laid out as one array of symbols. An index maps
the rank of each adjacent pair to all its positions; active ranks are taken in ascending order from a
heap, all positions of a pair are merged at once, left to right, and the pairs that arise beside them
enter the lists of their own ranks. Words never interact, so each ends as it would alone.

Ids equal those of the tokenizers library for the same file (without special tokens added, truncation
or padding); strings of added tokens in a text become their ids. Null and empty texts have no ids, and
come back as an empty text. Equal rows get equal ids, an empty table gives an empty result, and other
columns stay as they are: a column that has the name of the result is replaced. There are no ties: of
equal pairs the leftmost merges first, as the ranks are all different. Nothing is shuffled; memory is
bounded by a slice of a batch (or one longer text) and a word table that is emptied when it is full.
"""

from __future__ import annotations

import heapq
import itertools
import json
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a task keeps between slices.
WORD_TABLE = 100_000
#: Bytes of text that are split, and tokens that are decoded, at once.
SLICE = 2 << 20
#: Characters that the regex module and the tokenizers library class alike, whatever Unicode version they know.
COMMON = "\u0000-՗‐-⁯ぁ-ゖァ-ヺ一-龥가-힣"


def _byte_characters() -> dict[int, str]:
    """The printable stand-ins of bytes in a byte-level vocabulary."""
    plain = [b for b in range(256) if chr(b).isprintable() and b != 32 and b != 0xAD and b < 0x100 and not 0x7F <= b <= 0xA0]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """The vocabulary, merges and added tokens of a tokenizer file."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        stand_in = _byte_characters()
        byte_of = {c: b for b, c in stand_in.items()}
        self.symbol = np.array([vocab[stand_in[b]] for b in range(256)], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left, self.right, self.merged = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        keys = self.left * self.size + self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        pieces = [b""] * self.size
        for piece, i in vocab.items():
            pieces[i] = bytes(byte_of[c] for c in piece)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for piece, i in self.added.items():
            pieces[i] = piece.encode()
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.split = regex.compile(pattern).findall
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.uncommon = regex.compile(f"[^{COMMON}]").search

    @cached_property
    def pre_tokenizer(self):
        """The library's own splitter, for texts of scripts that it may class otherwise."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).pre_tokenizer

    def pre_tokens(self, text: str) -> list[str]:
        if self.uncommon(text):
            return [text[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(text)]
        return self.split(text)

    def words(self, text: str) -> list[str]:
        """The text's pre-tokens; added tokens stay whole."""
        if self.split_added is None or not any(x in text for x in self.added):
            return self.pre_tokens(text)
        out: list[str] = []
        for part in self.split_added(text):
            out += [part] if part in self.added else self.pre_tokens(part) if part else []
        return out

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, -1 where they don't merge."""
        wanted = left.astype(np.int64) * self.size + right
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[place] == wanted, self.order[place], -1)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the words' bounds in them."""
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        symbols = self.symbol[np.frombuffer(b"".join(raw), np.uint8)]
        for k in [k for k, w in enumerate(words) if w in self.added]:
            symbols[bounds[k]] = self.added[words[k]]
            symbols[bounds[k] + 1 : bounds[k + 1]] = -1
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[bounds[1:][lengths > 0] - 1] = -1
        before[bounds[:-1][lengths > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(places: np.ndarray) -> None:
            rank = self.ranks(symbols[places], symbols[after[places]])
            known = np.flatnonzero(rank >= 0)
            if not len(known):
                return
            places, rank = places[known], rank[known]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            edges = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            starts = [0, *edges.tolist(), len(rank)]
            for r, a, b in zip(rank[starts[:-1]].tolist(), starts, starts[1:], strict=False):
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heapq.heappush(active, r)

        enter(np.flatnonzero((after >= 0) & (symbols >= 0)))
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[rank], self.right[rank]
            at = at[(symbols[at] == a) & (after[at] >= 0)]
            at = at[symbols[after[at]] == b]
            if a == b and len(at) > 1:  # runs of the same symbol pair up from the left
                at = np.unique(at)
                joined = np.concatenate([[False], after[at[:-1]] == at[1:]])
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(joined, 0, place))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbols[at], symbols[gone], after[at] = self.merged[rank], -1, beyond
            inner = beyond >= 0
            before[beyond[inner]] = at[inner]
            left = before[at]
            enter(np.concatenate([left[left >= 0], at[inner]]))
        kept = symbols >= 0
        return symbols[kept], np.concatenate([[0], np.cumsum(kept)])[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of runs of ids; what isn't UTF-8 becomes the replacement character."""
        sizes = np.diff(self.piece_bounds)[ids]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        raw = self.piece_bytes[np.repeat(self.piece_bounds[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        cuts = ends[bounds].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]


@cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


class WordTable(dict):
    """Places of words in the order in which they came."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about a slice of bytes each; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield at, to
        at = to


def _encoded(texts: pa.Array, own: Encoder, table: WordTable, ids: np.ndarray, bounds: np.ndarray):
    """A list array of the texts' ids, and the grown table's ids and bounds."""
    known = len(table)
    docs = [np.fromiter(map(table.__getitem__, own.words(x.as_py() or "")), np.int32) for x in texts]
    if len(table) > known:
        more, ends = own.encode(list(itertools.islice(table, known, None)))
        bounds = np.concatenate([bounds, bounds[-1] + ends[1:]])
        ids = np.concatenate([ids, more])
    each = np.concatenate(docs) if docs else np.empty(0, np.int32)
    count = np.diff(bounds)[each]
    ends = np.concatenate([[0], np.cumsum(count)])
    flat = ids[np.repeat(bounds[each] - ends[:-1], count) + np.arange(ends[-1])]
    cuts = ends[np.concatenate([[0], np.cumsum([len(d) for d in docs])])]
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int32())), ids, bounds


def _append(df: DataFrame, name: str, kind: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name.lower() != name.lower()), f"`{name}` {kind}"])


def encode(df: DataFrame, path: str, pattern: str, *, text: str = "text", out: str = "ids") -> DataFrame:
    """df with an array column of the text's ids; a column of that name is replaced, all others stay."""
    names = [c for c in df.columns if c.lower() != out.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        table, ids, bounds = WordTable(), np.empty(0, np.int32), np.zeros(1, np.int64)
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for a, b in _slices(columns[text]):
                got, ids, bounds = _encoded(columns[text].slice(a, b - a), own, table, ids, bounds)
                yield pa.RecordBatch.from_arrays([*(columns[c].slice(a, b - a) for c in names), got], [*names, out])
                if len(table) > WORD_TABLE:
                    table, ids, bounds = WordTable(), np.empty(0, np.int32), np.zeros(1, np.int64)

    return df.mapInArrow(run, _append(df, out, "array<int>"))


def decode(df: DataFrame, path: str, pattern: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with a column of the texts that ids stand for; null ids are an empty text."""
    names = [c for c in df.columns if c.lower() != out.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            counts = pc.fill_null(pc.list_value_length(columns[ids]), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(counts)
            at = 0
            while at < len(batch):
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + SLICE // 4, "right")))
                lists = columns[ids].slice(at, to - at)
                texts = own.decode(lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts[at:to])]))
                yield pa.RecordBatch.from_arrays([*(columns[c].slice(at, to - at) for c in names), pa.array(texts, pa.string())], [*names, out])
                at = to

    return df.mapInArrow(run, _append(df, out, "string"))


def digest(decoded: DataFrame, *, doc_id: str = "doc_id", ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Counts and hashes of ids and texts per document."""
    joined = F.array_join(F.col(ids).cast("array<string>"), ",")
    return decoded.select(F.col(doc_id), F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.encode(joined, "utf-8"), 256).alias("ids_sha256"), F.sha2(F.encode(F.col(text), "utf-8"), 256).alias("decoded_sha256"))
