"""Document fingerprints by consistent weighted sampling.

A document is a bag of terms: words (runs of ASCII letters and digits and of characters beyond ASCII, A-Z in
lower case; or `width` of them in a row), each with the number of its occurrences as its weight S. For each
of `samples` positions a term draws r and c from Gamma(2, 1) and b from [0, 1), which depend on nothing but the
term and the position; with t = floor(ln S / r + b) its value is ln c - r (t - b + 1), and the document's sample is
the least value of its terms. Two documents share a sample just where the same term with the same t wins in both,
whose chance is their generalised Jaccard similarity, the sum of lesser weights over the sum of greater ones.

A term's value is a function of the term and of t alone, so the value itself, rounded to 32 bits, says who won; a sample
is kept as 16 bits of its hash, which lets two different ones agree with a chance of 1 / 65,536.

Values are drawn once for each term and weight of a worker's cache, which is bounded, not once an occurrence. Texts
are hashed whole, a block of words at a time.

Nulls and empty texts have no terms, a fingerprint of their own (of no winners) and a likeness of 1 to each
other, 0 to others. A text without words, such as one of signs only, is one term by itself. Equal texts have equal fingerprints.

`with_next` gives each row what follows it in an order: rows are sorted by ranges, one sort that moves each text
once, and a range is read as a stream that holds one row. Only the last row of a range still lacks its successor, the first row of the next
range that has any; these are written with their texts and joined, two rows a range. Nulls in the order come last; rows of equal
order are ordered by a hash of their texts. Rows that repeat follow each other; a table of one row follows itself; an empty one gives an empty result.
Only the columns named are read, so others, whatever their names, are of no effect.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from larkspur.session import Scratch

from .wordhash import ALNUM, FOLD, U, mix, words

SAMPLES = 128
#: Terms with their weights of which a worker keeps the values: 64 MB at 128 samples.
CACHED = 1 << 17
_BITS, _HALVES, _STEP = 1.0 / (1 << 53), 1.0 / (1 << 64), U(0x9E3779B97F4A7C15)


def draw(terms: np.ndarray, weights: np.ndarray, samples: int) -> np.ndarray:
    """Values of terms (64-bit hashes) with their weights: a row a term, a column a sample."""
    with np.errstate(over="ignore"):
        seeds = mix(terms[:, None] ^ mix(np.arange(1, samples + 1, dtype=np.uint64) * _STEP)[None, :])
        one, two = mix(seeds + _STEP), mix(seeds + _STEP + _STEP)
    # Each hash gives two numbers of 32 bits; -log of the product of two is a draw from Gamma(2, 1).
    gamma = lambda x: -np.log(((x >> U(32)).astype(np.float64) + 0.5) * ((x & U(0xFFFFFFFF)).astype(np.float64) + 0.5) * _HALVES)
    r, b = gamma(one), (seeds >> U(11)).astype(np.float64) * _BITS
    t = np.floor(np.log(weights)[:, None] / r + b)
    return (np.log(gamma(two)) - r * (t - b + 1)).astype(np.float32)


class Sampler:
    """Signatures of texts; keeps the values of terms that it has met."""

    def __init__(self, samples: int, width: int):
        self.samples, self.width = samples, width
        self.keys, self.places = np.empty(0, np.uint64), np.empty(0, np.int64)  # sorted keys, and the row of values of each
        self.values = np.empty((CACHED, samples), np.float32)

    def of(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Values of at most a cache of terms with their weights; draws those that it has not met."""
        keys = mix(terms + mix(weights.astype(np.uint64)))
        fresh, at = np.unique(keys, return_index=True)
        known = np.searchsorted(self.keys, fresh)
        new = np.append(self.keys, U(0))[known] != fresh if len(self.keys) else np.ones(len(fresh), bool)
        if len(self.keys) + new.sum() > CACHED:  # begin anew, with what is needed now
            self.keys, self.places, known, new = self.keys[:0], self.places[:0], np.zeros(len(fresh), np.int64), np.ones(len(fresh), bool)
        if new.any():
            rows, n = np.arange(len(self.keys), len(self.keys) + new.sum()), at[new]
            for a in range(0, len(n), 256):  # so many that their numbers stay in the processor's cache
                self.values[rows[a : a + 256]] = draw(terms[n[a : a + 256]], weights[n[a : a + 256]], self.samples)
            self.keys, self.places = np.insert(self.keys, known[new], fresh[new]), np.insert(self.places, known[new], rows)
        return self.values[self.places[np.searchsorted(self.keys, keys)]]

    def signatures(self, texts: list[str | None]) -> np.ndarray:
        """A row of 16-bit samples for each text; 0 throughout where there are no terms, else never 0."""
        out = np.zeros((len(texts), self.samples), "<u2")
        for block in words(pa.array(texts, pa.large_string()), ALNUM, FOLD):
            owner, hashes = block.owner(), block.hashes
            if self.width > 1:
                short = np.flatnonzero((block.counts > 0) & (block.counts < self.width))
                starts, shingles = block.windows(self.width)
                whole = np.array([np.bitwise_xor.reduce(mix(hashes[block.bounds[k] : block.bounds[k + 1]] + np.arange(block.counts[k], dtype=np.uint64))) for k in short], np.uint64)
                owner, hashes = np.concatenate([owner[starts], short]), np.concatenate([shingles, whole])
            bare = [k for k in np.flatnonzero(block.counts == 0) if texts[block.docs[k]]]
            if bare:
                own = [int.from_bytes(hashlib.sha256(texts[block.docs[k]].encode()).digest()[:8], "big") for k in bare]
                owner, hashes = np.concatenate([owner, bare]), np.concatenate([hashes, np.array(own, np.uint64)])
            if not len(hashes):
                continue
            order = np.lexsort((hashes, owner))
            owner, hashes = owner[order], hashes[order]
            first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])]))
            weights = np.diff(np.append(first, len(owner)))
            self._least(out, block.docs, owner[first], hashes[first], weights)
        return out

    def _least(self, out: np.ndarray, docs: np.ndarray, owner: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        """The least values of each document, taken a few thousand terms at a time."""
        least: dict[int, np.ndarray] = {}
        for a in range(0, len(owner), 16384):
            part = slice(a, a + 16384)
            own = owner[part]
            edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            values = np.minimum.reduceat(self.of(terms[part], weights[part]), edges, axis=0)
            for k, row in zip(own[edges].tolist(), values, strict=True):
                least[k] = np.minimum(least[k], row) if k in least else row
        rows = np.stack(list(least.values()))
        bits = (mix(rows.view(np.uint32).astype(np.uint64)) >> U(48)).astype(np.uint16)
        out[docs[list(least)]] = np.maximum(bits, 1)


@cache
def sampler(samples: int = SAMPLES, width: int = 1) -> Sampler:
    """The sampler of this worker, whose cache goes on from task to task."""
    return Sampler(samples, width)


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """The share of samples that agree."""
    return float((one == two).mean())


def text_form(signature: np.ndarray) -> str:
    """A fingerprint as hex digits, four a sample."""
    return signature.tobytes().hex()


def fingerprint(docs: DataFrame, *, text: str = "text", out: str = "fingerprint", samples: int = SAMPLES, width: int = 1) -> DataFrame:
    """docs with the fingerprint of a text column, which replaces a column called out."""
    columns = [c for c in docs.columns if c != out]
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != out), f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_sampler = sampler(samples, width)
        for batch in batches:
            given = dict(zip(batch.schema.names, batch.columns, strict=True))
            own = [text_form(s) for s in own_sampler.signatures(given[text].to_pylist())]
            yield pa.RecordBatch.from_arrays([*(given[c] for c in columns), pa.array(own, pa.string())], [*columns, out])

    return docs.mapInArrow(run, kinds)


def jaccard(one: Column, two: Column) -> Column:
    """The likeness of two fingerprints: an estimate of the generalised Jaccard similarity of what they stand for."""
    n = F.length(one) / 4
    same = F.aggregate(F.sequence(F.lit(1), F.length(one) - 3, F.lit(4)), F.lit(0), lambda s, i: s + (F.substring(one, i, F.lit(4)) == F.substring(two, i, F.lit(4))).cast("int"))
    return same / n


def spliced(text: str | None, following: str | None) -> str:
    """text, the last third of whose characters are replaced by the first as many, or all, of what follows."""
    text = text or ""
    m = len(text) // 3
    return text[: len(text) - m] + (following or "")[:m]


_ROW = "key {key}, part long, kind string, text string, n_chars long, edited_sha256 string, own binary, edited binary, near_edited double, near_next double"
_DONE, _LAST, _FIRST = "done", "last", "first"


def _compared(sampled: Sampler, keys: list, texts: list[str | None], following: list[str | None], own: np.ndarray, after: np.ndarray) -> list[dict]:
    edits = [spliced(a, b) for a, b in zip(texts, following, strict=True)]
    edited = sampled.signatures(edits)
    return [
        {
            "key": keys[i], "n_chars": len(texts[i] or ""), "edited_sha256": hashlib.sha256(edits[i].encode()).hexdigest(), "own": own[i].tobytes(), "edited": edited[i].tobytes(),
            "near_edited": likeness(own[i], edited[i]), "near_next": likeness(own[i], after[i]),
        }
        for i in range(len(texts))
    ]


def _slices(batch: pa.RecordBatch, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of a batch, about so many bytes of text at a time."""
    first = held = 0
    for i, n in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        held += n or 0
        if held > size:
            yield batch.slice(first, i + 1 - first)
            first, held = i + 1, 0
    if first < batch.num_rows:
        yield batch.slice(first)


def _stream(samples: int, width: int, kinds: pa.Schema):
    """Reads the rows of a range in order; each meets the next, the last one is left for later, as is the first one's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, sampled = TaskContext.get().partitionId(), sampler(samples, width)
        held = None  # key, text and signature of the row before
        began = False
        for batch in batches:
            for piece in _slices(batch):
                keys, texts = piece.column("key").to_pylist(), piece.column("text").to_pylist()
                own = sampled.signatures(texts)
                rows: list[dict] = []
                if not began:
                    rows.append({"key": keys[0], "kind": _FIRST, "text": texts[0], "own": own[0].tobytes()})
                    began = True
                if held is not None:
                    keys, texts, own = [held[0], *keys], [held[1], *texts], np.concatenate([held[2][None], own])
                rows += [r | {"kind": _DONE} for r in _compared(sampled, keys[:-1], texts[:-1], texts[1:], own[:-1], own[1:])]
                held = keys[-1], texts[-1], own[-1]
                yield pa.RecordBatch.from_pylist([r | {"part": part} for r in rows], kinds)
        if held is not None:
            yield pa.RecordBatch.from_pylist([{"key": held[0], "kind": _LAST, "text": held[1], "own": held[2].tobytes(), "part": part}], kinds)

    return run


def _stitch(samples: int, width: int, kinds: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampled = sampler(samples, width)
        for batch in batches:
            given = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            own, after = (np.stack([np.frombuffer(x, np.uint16) for x in given[c]]) if batch.num_rows else np.zeros((0, samples), np.uint16) for c in ("own", "next_own"))
            rows = _compared(sampled, given["key"], given["text"], given["next_text"], own, after)
            yield pa.RecordBatch.from_pylist([r | {"kind": _DONE, "part": None} for r in rows], kinds)

    return run


def with_next(scratch: Scratch, docs: DataFrame, *, key: str = "doc_id", text: str = "text", samples: int = SAMPLES, width: int = 1) -> DataFrame:
    """Of each row key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next, where next is the row of the next lower key (of the lowest, the highest) and the edited text is `spliced` with it.

    The result reads tables of scratch, so it must be written before these are deleted.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    kind = _ROW.format(key=dict(rows.dtypes)["key"])
    arrow = to_arrow_schema(docs.sparkSession.createDataFrame([], kind).schema)
    order = [F.col("key").desc_nulls_last(), F.col("tie")]  # bounds of ranges are sampled from what orders, so texts are not in it
    read = scratch.save(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text").mapInArrow(_stream(samples, width, arrow), kind))
    # Two narrow rows a range: each range's successor, and the first one's for the last.
    in_order = Window.orderBy("part")
    parts = read.where(F.col("kind") == _FIRST).select("part").withColumn("_next", F.coalesce(F.lead("part").over(in_order), F.first("part").over(in_order)))
    last = read.where(F.col("kind") == _LAST).select("part", "key", "text", "own").join(parts, "part")
    first = read.where(F.col("kind") == _FIRST).select(F.col("part").alias("_next"), F.col("text").alias("next_text"), F.col("own").alias("next_own"))
    stitched = last.join(first, "_next").select("key", "text", "own", "next_text", "next_own").mapInArrow(_stitch(samples, width, arrow), kind)
    swap = lambda c: F.lower(F.hex(c)).alias({"own": "fingerprint", "edited": "edited_fingerprint"}[c])
    both = read.where(F.col("kind") == _DONE).unionByName(stitched)
    return both.select("key", "n_chars", "edited_sha256", swap("own"), swap("edited"), "near_edited", "near_next")
