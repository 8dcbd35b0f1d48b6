"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against training token windows.

Words are runs of ASCII letters and digits and of any characters beyond ASCII, A-Z in lower case. A
window of an item is `width` consecutive words; an item of fewer words, but not none, is one window.
Every occurrence of a window in a document is found by its hash, verified on the words themselves,
and all its words are hit.

A broadcast set is made of at most `block_bytes` of items' text, which is checked first, and takes about five times that: a
hash, an item and two offsets for each window, beside the words. Items that repeat are taken once. A larger benchmark is
packed into blocks by the running size of its items, so a block holds `block_bytes` and what its last item has beyond them. The
documents are scanned for one block at a time, and a block's broadcast is destroyed before the next is made, so
driver and workers hold one block at a time. Of all blocks but the last only the hits are written: for each text that has any a
digest, its marked words as bits and its items; these are joined to the documents by the text's digest in the last scan and deleted. With one
block documents are never shuffled.

Nulls and texts without words have no words, no hits and no items. Items that are null or have no
words have no windows; an empty benchmark hits nothing, an empty table gives an empty result. A null
item_id counts for hits but is not listed. Repeated rows are judged alike, each by itself; there are no ties, as of items with
equal windows all are listed. Texts of any length are scanned whole, a block of words at a time. Other
columns of the inputs are kept as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators.windows import running
from larkspur.session import Scratch, saved, unused

from .wordhash import ALNUM, FOLD, U, windows, words

WIDTH = 13
BLOCK_BYTES = 32 << 20


@dataclass
class Windows:
    """The windows of one size in order of their hashes, with the item of each and where its words (joined by spaces) stand in the block's text."""

    hashes: np.ndarray
    items: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bits: np.ndarray
    text: bytes
    ids: list[str | None]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the hashes that are in the set, and their first places in it."""
        maybe = np.flatnonzero(self.bits[(hashes >> U(44)).astype(np.int64)])
        place = np.searchsorted(self.hashes, hashes[maybe])
        found = self.hashes[np.minimum(place, len(self.hashes) - 1)] == hashes[maybe]
        return maybe[found], place[found]

    def items_of(self, place: int, words: bytes) -> set[str] | None:
        """The items that have a window of these words, from its hash's first place on; nothing if none has."""
        last = int(np.searchsorted(self.hashes, self.hashes[place], "right"))
        same = [q for q in range(place, last) if self.text[self.starts[q] : self.ends[q]] == words]
        return {self.ids[self.items[q]] for q in same} - {None} if same else None


def item_windows(ids: list[str | None], texts: list[str | None], width: int) -> dict[int, Windows]:
    """The windows of some items by their size."""
    found: dict[int, list[tuple[np.ndarray, ...]]] = {}
    text, base = [], 0
    for block in words(pa.array(texts, pa.large_string()), ALNUM):
        for k, doc in enumerate(block.docs):
            a, b = block.bounds[k : k + 2]
            size = min(width, int(b - a))
            if not size:
                continue
            lengths = block.ends[a:b] - block.starts[a:b]
            text.append(b" ".join(block.data[s:e].tobytes() for s, e in zip(block.starts[a:b], block.ends[a:b], strict=True)))
            at = base + np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
            base += len(text[-1]) + 1
            starts, hashes = windows(block.hashes[a:b], np.zeros(b - a, np.int8), size)
            found.setdefault(size, []).append((hashes, np.full(len(starts), doc, np.int32), at[starts], at[starts + size - 1] + lengths[starts + size - 1]))
    whole = b" ".join(text)
    out = {}
    for size, parts in found.items():
        hashes, items, starts, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(hashes, kind="stable")
        bits = np.zeros(1 << 20, bool)
        bits[(hashes >> U(44)).astype(np.int64)] = True
        out[size] = Windows(hashes[order], items[order], starts[order], ends[order], bits, whole, ids)
    return out


def _separated(raw: bytes) -> bytes:
    return b" ".join(raw.translate(_SEPARATE).split())


#: Bytes that are in no word become spaces.
_SEPARATE = bytes(b if ALNUM[b] else 32 for b in range(256))


def scan(texts: pa.Array, sets: dict[int, Windows]) -> Iterator[tuple[int, np.ndarray, set[str], int, np.ndarray, np.ndarray]]:
    """For each text: its place, marks of the words that are hit, items, number of words, starts and ends of words in its bytes."""
    for block in words(texts, ALNUM, FOLD):
        owner = block.owner()
        edge = np.zeros(len(block.hashes) + 1, np.int32)
        items: dict[int, set[str]] = {}
        known: dict[tuple[int, bytes], set[str] | None] = {}
        raw = block.data
        for size, own in sets.items():
            starts, hashes = block.windows(size)
            at, place = own.find(hashes)
            for i, p in zip(starts[at].tolist(), place.tolist(), strict=True):
                span = raw[block.starts[i] : block.ends[i + size - 1]].tobytes()
                if (size, span) not in known:
                    known[size, span] = own.items_of(p, _separated(span))
                if (got := known[size, span]) is not None:
                    edge[i] += 1
                    edge[i + size] -= 1
                    items.setdefault(int(owner[i]), set()).update(got)
        hit = np.cumsum(edge[:-1]) > 0
        for k, doc in enumerate(block.docs):
            a, b = block.bounds[k : k + 2]
            yield int(doc), hit[a:b], items.get(k, set()), int(b - a), block.starts[a:b] - block.edges[k], block.ends[a:b] - block.edges[k]


def _blocks(scratch: Scratch, benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> tuple[DataFrame, list[int]]:
    """The benchmark's different items with the block of each, and the blocks that have any."""
    name = lambda c: F.col(f"`{c}`").cast("string")
    own = scratch.save(benchmark.select(name(item_id).alias("item"), name(text).alias("words")).where(F.length("words") > 0).distinct())
    size = F.octet_length("words")
    if own.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= block_bytes:
        return own.withColumn("block", F.lit(0)), [0]
    sized = running(own.withColumn("digest", F.xxhash64("words", "item")), size, at="digest", tie="item", size=None, out="upto")
    dealt = scratch.save(sized.select("item", "words", F.floor((F.col("upto") - size) / F.lit(block_bytes)).cast("int").alias("block")))
    return dealt, [r.block for r in dealt.select("block").distinct().orderBy("block").collect()]


_RESULT = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def find(documents: DataFrame, benchmark: DataFrame, *, out: str = "found", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES, offsets: bool = True) -> DataFrame:
    """documents with a struct column of what was found: n_words, n_hit, spans of hit runs in bytes (if offsets), sorted items.

    out: a name that no column of documents has (`unused` makes one).
    """
    if unused(out, documents.columns) != out:
        raise ValueError(f"documents has a column {out!r}")
    sc = documents.sparkSession.sparkContext
    kind = "struct<n_words:long,n_hit:long,spans:array<struct<start:long,end:long>>,items:array<string>>"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)
    own, so_far = documents, None
    with Scratch(documents.sparkSession) as scratch:
        items, blocks = _blocks(scratch, benchmark, item_id, item_text, block_bytes)
        held = lambda block: (r := items.where(F.col("block") == block).collect(), sc.broadcast(item_windows([x.item for x in r], [x.words for x in r], width)))[1]
        if len(blocks) > 1:
            so_far = unused("so_far", [*documents.columns, out])
            keyed = documents.select(F.md5(F.col(f"`{text}`").cast("string").cast("binary")).alias("digest"), F.col(f"`{text}`").alias("text"))
            hits = []
            for block in blocks[:-1]:
                sets = held(block)
                marked = keyed.mapInArrow(_marker(sets), "digest string, bits binary, items array<string>")
                hits.append(scratch.save(marked.groupBy("digest").agg(F.first("bits").alias("bits"), F.first("items").alias("items"))))
                sets.destroy()
            each = F.collect_list(F.struct("bits", "items")).alias(so_far)  # one a block at most
            known = saved(reduce(DataFrame.unionByName, hits).groupBy(F.col("digest").alias(f"{so_far}_")).agg(each))
            own = documents.join(known, F.md5(F.col(f"`{text}`").cast("string").cast("binary")) == F.col(f"{so_far}_"), "left").drop(f"{so_far}_")
        sets = held(blocks[-1])
    return own.mapInArrow(_scanner(sets, text, documents.columns, out, so_far, offsets), f"{fields}, `{out}` {kind}")


def _marker(sets):
    """The texts that hold windows of one block, by their digests, with their marked words as bits and their items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = batch.column("digest")
            rows = [(digests[doc].as_py(), np.packbits(hit).tobytes(), sorted(items)) for doc, hit, items, *_ in scan(batch.column("text"), sets.value) if hit.any()]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary(), pa.list_(pa.string())), strict=True)], ["digest", "bits", "items"])

    return run


def _scanner(sets, text: str, columns: list[str], name: str, so_far: str | None, offsets: bool):
    """Scans batches for the windows of the last block and adds what was found before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = dict(zip(batch.schema.names, batch.columns, strict=True))
            rows: list[dict] = []
            for doc, hit, items, n, starts, ends in scan(given[text], sets.value):
                for known in (given[so_far][doc].as_py() or []) if so_far else []:
                    hit = hit | np.unpackbits(np.frombuffer(known["bits"], np.uint8), count=n).astype(bool)
                    items = items | set(known["items"])
                row: dict = {"n_words": n, "n_hit": int(hit.sum()), "spans": [], "items": sorted(items)}
                if offsets and row["n_hit"]:
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                    row["spans"] = [{"start": int(starts[i]), "end": int(ends[j - 1])} for i, j in zip(turn[::2], turn[1::2], strict=True)]
                rows.append(row)
            yield pa.RecordBatch.from_arrays([*(given[c] for c in columns), pa.array(rows, _RESULT)], [*columns, name])

    return run


def contaminated(found: str = "found", percent: int = 5) -> Column:
    """Whether at least so many percent of the words are hit."""
    n_hit, n_words = (F.col(f"`{found}`.{c}") for c in ("n_hit", "n_words"))
    return (n_hit > 0) & (n_hit * 100 >= n_words * percent)


def drop(documents: DataFrame, benchmark: DataFrame, percent: int = 5, **options) -> DataFrame:
    """documents without those of which at least so many percent of the words are hit; all columns are kept."""
    out = unused("found", documents.columns)
    return find(documents, benchmark, out=out, offsets=False, **options).where(~contaminated(out, percent)).drop(out)


def redact(documents: DataFrame, benchmark: DataFrame, *, text: str = "text", mark: str = "", **options) -> DataFrame:
    """documents with every hit run of words replaced by mark."""
    out = unused("found", documents.columns)
    found = find(documents, benchmark, out=out, text=text, **options)
    raw, spans = F.encode(F.col(text), "utf-8"), F.col(f"`{out}`.spans")
    before = lambda i: F.when(i > 0, F.try_element_at(spans, F.greatest(i, F.lit(1)).cast("int"))["end"]).otherwise(F.lit(0))
    kept = F.transform(spans, lambda x, i: F.concat(F.decode(F.substring(raw, (before(i) + 1).cast("int"), (x["start"] - before(i)).cast("int")), "utf-8"), F.lit(mark)))
    last = F.decode(F.substring(raw, (F.try_element_at(spans, F.lit(-1))["end"] + 1).cast("int"), F.octet_length(F.col(text))), "utf-8")
    return found.withColumn(text, F.when(F.size(spans) > 0, F.concat(F.array_join(kept, ""), last)).otherwise(F.col(text))).drop(out)


def digest(found: DataFrame, doc_id: str = "doc_id", out: str = "found") -> DataFrame:
    """The report per document: counts, hash of the items and the verdict."""
    items = F.array_join(F.array_sort(f"{out}.items"), ",")
    return found.select(F.col(doc_id), F.col(f"{out}.n_words").alias("n_words"), F.col(f"{out}.n_hit").alias("n_hit"), F.size(f"{out}.items").cast("long").alias("n_items"), F.sha2(F.encode(items, "utf-8"), 256).alias("items_sha256"), contaminated(out).alias("contaminated"))
