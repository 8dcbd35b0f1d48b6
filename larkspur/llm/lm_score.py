"""Stupid-backoff scores from n-gram counts of the corpus itself, computed by joins.

Documents are dealt into blocks of bounded size by a hash. Each block's distinct n-grams, with its own
counts, go to the partitions of the count table, which is dealt by the n-gram's hash; the table sums each
n-gram over the blocks, and the sums are joined back to the blocks that asked for them, where every
position is scored and summed per document. An n-gram thus crosses the network once a block however
often it occurs, so frequent words are no hot keys. The relation's rows are packed: a row holds all
n-grams of one block that go to one partition, as a row for each takes more than the check's time allows
(README has the figures).

S(w | u) = c(u w) / c(u), where c(u w) > 0, and alpha * c(w) / N otherwise; a document's own
occurrences are left out of all counts, as else no bigram would ever back off. A word unseen elsewhere
scores alpha * alpha / N. The first word has no context and takes the unigram score without alpha.

Words are what white space separates, A-Z in lower case. Null and blank texts have no words, and a
null mean. Rows are scored each by itself: copies of a document count as other documents. Equal rows
get equal scores, an empty table gives an empty result, and there are no ties. Rows of an id that stands
on very many of them are dealt over blocks by a number that is written first, so that a lost executor
cannot deal them anew. A text is scored whole: one longer than a block makes its block larger. Other
columns are ignored. Counts are of 64-bit hashes of n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import saved

from .wordhash import FOLD, NOT_SPACE, U, words

ALPHA = 0.4
BLOCK_BYTES = 8 << 20
#: Bytes of text whose n-grams make one partition of the count table.
TABLE_BYTES = 64 << 20
#: An id on more rows than this is dealt over blocks row by row.
HOT_ROWS = 1000


def sizes(documents: DataFrame, text: str) -> tuple[int, int]:
    """Words and bytes of all texts."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [(len(b.hashes), len(b.data)) for b in words(batch.column(0), NOT_SPACE)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(x[k] for x in n)], pa.int64()) for k in (0, 1)], ["n_words", "n_bytes"])

    row = documents.select(F.col(text).cast("string")).mapInArrow(measured, "n_words long, n_bytes long").agg(F.sum("n_words"), F.sum("n_bytes")).first()
    return row[0] or 0, row[1] or 0


def ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all positions, in order: the document, the word's hash, and the hash of it with the word before (0 at a document's start)."""
    owners, singles, pairs = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    for block in words(texts, NOT_SPACE, FOLD):
        owner = block.owner()
        pair = np.zeros(len(owner), np.uint64)
        starts, hashes = block.windows(2)
        pair[starts + 1] = hashes | U(1)
        owners.append(block.docs[owner] if len(owner) else owner)
        singles.append(block.hashes | U(1))
        pairs.append(pair)
    return np.concatenate(owners), np.concatenate(singles), np.concatenate(pairs)


def _keys(single: np.ndarray, pair: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams by partition and hash, their counts, and the partitions' bounds."""
    keys, counts = np.unique(np.concatenate([single, pair[pair > 0]]), return_counts=True)
    part = ((keys >> U(20)) % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return keys[order], counts[order], np.searchsorted(part[order], np.arange(parts + 1))


def score(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_backoff (positions scored by their word alone), log_score (sum of natural logarithms), mean_log_score."""
    n_all, n_bytes = sizes(documents, text)
    shuffles = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(2 * shuffles, -(-n_bytes // block_bytes))
    parts = max(2 * shuffles, -(-n_bytes // TABLE_BYTES))
    id_type = documents.select(F.col(doc_id)).schema[0].dataType.simpleString()
    own = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    hot = own.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS)
    own = own.withColumn("salt", F.lit(0).cast("long"))
    if not hot.isEmpty():
        own = saved(own.withColumn("salt", F.monotonically_increasing_id()))
    own = own.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text", "salt"), F.lit(blocks)).cast("int").alias("block"))

    def asked(table: pa.Table) -> pa.Table:
        keys, counts, bounds = _keys(*ngrams(table.column("text"))[1:], parts)
        full = np.flatnonzero(np.diff(bounds))
        cut = [(bounds[p], bounds[p + 1]) for p in full]
        raw = pa.array([keys[a:b].tobytes() for a, b in cut], pa.binary())
        small = pa.array([counts[a:b].astype(np.uint32).tobytes() for a, b in cut], pa.binary())
        block = table.column("block")[0].as_py()
        return pa.table({"block": pa.array([block] * len(full), pa.int32()), "part": pa.array(full, pa.int32()), "keys": raw, "counts": small})

    def summed(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")]
        counts = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table.column("counts")])
        inverse = np.unique(np.concatenate(keys), return_inverse=True)[1]
        total = np.bincount(inverse, counts).astype(np.uint64)[inverse]
        ends = np.cumsum([len(k) for k in keys])
        # most sums are small: they go back in as few bytes as the largest of a row takes
        back = [x.astype(np.uint8 if x.max() < 1 << 8 else np.uint32 if x.max() < 1 << 32 else np.uint64).tobytes() for x in np.split(total, ends[:-1])]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "sums": pa.array(back, pa.binary())})

    def scored(docs: pa.Table, got: pa.Table) -> pa.Table:
        owner, single, pair = ngrams(docs.column("text"))
        n = docs.num_rows
        n_words = np.bincount(owner, minlength=n)
        logs, backoffs = np.zeros(n), np.zeros(n, np.int64)
        if len(owner):
            keys, _, bounds = _keys(single, pair, parts)
            sums = np.zeros(len(keys))
            for p, raw in zip(got.column("part").to_pylist(), got.column("sums").to_pylist(), strict=True):
                a, b = bounds[p], bounds[p + 1]
                sums[a:b] = np.frombuffer(raw, {1: np.uint8, 4: np.uint32, 8: np.uint64}[len(raw) // (b - a)])
            order = np.argsort(keys)
            keys, sums = keys[order], sums[order]

            def others(at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
                """Counts of n-grams in all documents but that of their position."""
                place = np.searchsorted(keys, hashes)
                _, inverse, mine = np.unique(owner[at] * len(keys) + place, return_inverse=True, return_counts=True)
                return sums[place] - mine[inverse]

            one = others(np.arange(len(owner)), single)
            rest = np.maximum(n_all - n_words[owner], 1)
            inner = np.flatnonzero(pair)
            two = np.zeros(len(owner))
            two[inner] = others(inner, pair[inner])
            context = np.ones(len(owner))
            context[inner] = one[inner - 1]
            seen = two > 0
            weight = np.where(pair > 0, alpha, 1.0)
            value = np.where(seen, two / np.maximum(context, 1), np.where(one > 0, weight * one / rest, alpha * alpha / rest))
            logs = np.bincount(owner, np.log(value), minlength=n)
            backoffs = np.bincount(owner, ~seen, minlength=n).astype(np.int64)
        mean = pa.array(logs / np.maximum(n_words, 1), pa.float64(), mask=n_words == 0)
        return pa.table({doc_id: docs.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_backoff": pa.array(backoffs), "log_score": pa.array(logs), "mean_log_score": mean})

    table = own.groupBy("block").applyInArrow(asked, "block int, part int, keys binary, counts binary")
    sums = table.groupBy("part").applyInArrow(summed, "block int, part int, sums binary")
    return own.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(scored, f"`{doc_id}` {id_type}, n_words long, n_backoff long, log_score double, mean_log_score double")
