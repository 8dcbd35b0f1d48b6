"""Compression of vectors to product codes, learned on distinct integer parts.

Components become integers, floor(scale * x), and vectors are cut into `parts` equal consecutive parts. Equal
integer parts of a position are counted once: Lloyd's rounds run over the distinct ones with their counts as weights, and
their codes and errors are joined back to the vectors. All arithmetic is on integers, so results do not depend on how rows
are dealt out.

A round is one scan of the distinct parts with the codebooks broadcast: parts x entries x width integers, whatever the
number of vectors. Each task sums what falls to each entry, and sums of sums travel on. Parts that more than one vector in `HOT`
shares are fewer than HOT a position; they are joined back by a broadcast of so many rows at most, all others by a
shuffle in which no key has more than one row in HOT.

Dropped: vectors that are null, hold a null or a component that is not finite, are of a length that parts do not divide, or not as long as that
of the smallest id among the others. Integers are held to 26 bits and their sign, so that sums of squares fit in 64: components
of 16,384 and more at a scale of 4096 count as the greatest integer. Codebooks begin as the parts of the `entries` smallest ids
(null ids last, ties by the vector); fewer vectors make fewer entries. Repeated rows are vectors each. An empty table, or one of which nothing is
kept, gives an empty result. Columns other than those named are of no effect, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import Scratch

SCALE, PARTS, ENTRIES, ROUNDS, HOT = 4096, 8, 16, 6, 1000
_LEAST, _MOST = -(1 << 26), 1 << 26


def integers(vectors: pa.Array, scale: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable vectors of a column, and their integer components, as a matrix; without a width, that of the first usable one."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), np.int64)
    flat = pc.list_flatten(vectors)
    values = np.asarray(pc.fill_null(flat.cast(pa.float64()), float("nan")), np.float64)
    starts = np.cumsum(sizes) - sizes
    finite = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (sizes > 0) & (finite[starts + sizes] == finite[starts])
    if width is None:
        width = int(sizes[good][0]) if good.any() else 0
    rows = np.flatnonzero(good & (sizes == width))
    own = values[starts[rows][:, None] + np.arange(width)]
    return rows, np.clip(np.floor(own * scale), _LEAST, _MOST).astype(np.int32)


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the index of the nearest entry, the lowest of several, and its squared distance."""
    best = np.zeros(len(points), np.int64)
    error = np.full(len(points), np.iinfo(np.int64).max)
    for k, entry in enumerate(book):
        far = ((points - entry) ** 2).sum(axis=1)
        closer = far < error
        best[closer], error[closer] = k, far[closer]
    return best, error


def _cut(parts: int, scale: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, own = integers(batch.column("vector"), scale, width)
            raw = np.ascontiguousarray(own).reshape(-1).tobytes()
            size = width // parts * 4
            cells = pa.Array.from_buffers(pa.binary(), len(rows) * parts, [None, pa.py_buffer(np.arange(0, len(raw) + 1, size, dtype=np.int32).tobytes()), pa.py_buffer(raw)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * parts + 1, parts), pa.int32()), cells)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in ("id", "label")), lists], ["id", "label", "cells"])

    return run


def _points(cells: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), np.int32).reshape(-1, width).astype(np.int64)


def _gather(books, width: int):
    """Of each batch, how many points fall to each entry of a position, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            spots, weights = batch.column("spot").to_numpy(), batch.column("weight").to_numpy()
            points = _points(batch.column("cell"), width)
            for spot in np.unique(spots):
                here = spots == spot
                own, heavy = points[here], weights[here]
                best, _ = nearest(own, books.value[spot])
                for k in np.unique(best):
                    mine = best == k
                    rows += [(int(spot), int(k), -1, int(heavy[mine].sum())), *((int(spot), int(k), j, int(x)) for j, x in enumerate((own[mine] * heavy[mine][:, None]).sum(axis=0)))]
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["spot", "entry", "place", "amount"])

    return run


def _coder(books, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots, points = batch.column("spot").to_numpy(), _points(batch.column("cell"), width)
            code, error = np.zeros(len(spots), np.int64), np.zeros(len(spots), np.int64)
            for spot in np.unique(spots):
                here = spots == spot
                code[here], error[here] = nearest(points[here], books.value[spot])
            yield pa.RecordBatch.from_arrays([batch.column("spot"), batch.column("cell"), batch.column("weight"), pa.array(code, pa.int32()), pa.array(error, pa.int64())], ["spot", "cell", "weight", "code", "error"])

    return run


def learn(distinct: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks after so many rounds over distinct parts (spot, cell, weight). What reaches the driver in a round is a sum for each component of each entry."""
    sc = distinct.sparkSession.sparkContext
    width = books[0].shape[1]
    for _ in range(rounds):
        shared = sc.broadcast(books)
        sums = distinct.mapInArrow(_gather(shared, width), "spot int, entry int, place int, amount long").groupBy("spot", "entry", "place").agg(F.sum("amount").alias("amount"))
        next_books = [b.copy() for b in books]
        found = {(r.spot, r.entry, r.place): r.amount for r in sums.collect()}
        for (spot, entry, place), amount in found.items():
            if place >= 0:
                next_books[spot][entry, place] = amount // found[spot, entry, -1]
        shared.destroy()
        books = next_books
    return books


def books_text(books: list[np.ndarray]) -> str:
    """All integers of the codebooks in decimal, by position, entry and place, with commas between."""
    return ",".join(str(x) for b in books for x in b.reshape(-1).tolist())


def compress(scratch: Scratch, vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, hot: int = HOT) -> tuple[DataFrame, list[np.ndarray]]:
    """A row of each kept vector: id, label, codes (an array by position) and error; and the codebooks.

    The rows read tables of scratch, so they must be written before these are deleted.
    """
    name = lambda c: F.col(f"`{c}`")
    spark = vectors.sparkSession
    given = vectors.select(name(id).alias("id"), name(label).alias("label"), name(vector).cast("array<double>").alias("vector"))
    kinds = dict(given.dtypes)
    usable = given.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & (F.size("vector") % parts == 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    first = usable.orderBy(F.col("id").asc_nulls_last(), "vector").select(F.size("vector").alias("n")).first()
    empty = spark.createDataFrame([], f"id {kinds['id']}, label {kinds['label']}, codes array<int>, error long")
    if first is None:
        return empty, []
    width = first.n // parts
    heads = usable.where(F.size("vector") == first.n).orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()
    _, own = integers(pa.array([r.vector for r in heads], pa.list_(pa.float64())), scale, first.n)
    books = [own[:, s * width : (s + 1) * width].astype(np.int64) for s in range(parts)]

    cut = scratch.save(given.mapInArrow(_cut(parts, scale, first.n), f"id {kinds['id']}, label {kinds['label']}, cells array<binary>").withColumn("row", F.monotonically_increasing_id()))
    single = cut.select("row", F.posexplode("cells").alias("spot", "cell"))
    distinct = scratch.save(single.groupBy("spot", "cell").agg(F.count("*").alias("weight")))
    books = learn(distinct, books, rounds)
    shared = spark.sparkContext.broadcast(books)
    coded = scratch.save(distinct.mapInArrow(_coder(shared, width), "spot int, cell binary, weight long, code int, error long"))
    least = cut.count() / hot
    said = F.struct("code", "error")
    often = F.broadcast(coded.where(F.col("weight") > least).select("spot", "cell", said.alias("often")))
    seldom = coded.where(F.col("weight") <= least).select("spot", "cell", said.alias("said"))
    marked = single.join(often, ["spot", "cell"], "left")
    both = marked.where(F.col("often").isNotNull()).select("row", "spot", F.col("often").alias("said")).unionByName(marked.where(F.col("often").isNull()).select("row", "spot", "cell").join(seldom, ["spot", "cell"]).select("row", "spot", "said"))
    rows = both.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("spot", "said"))).alias("all"))
    codes = rows.select("row", F.transform("all", lambda x: x["said"]["code"]).alias("codes"), F.aggregate("all", F.lit(0).cast("long"), lambda s, x: s + x["said"]["error"]).alias("error"))
    return cut.select("row", "id", "label").join(codes, "row").select("id", "label", "codes", "error"), books


def label_errors(coded: DataFrame) -> DataFrame:
    """Rows (label, error, ...) with the errors summed over their label, nulls being one."""
    per = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(per, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def restore(coded: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """Rows (codes, ...) with the vector that their codes stand for."""
    flat = F.array(*(F.array(*(F.array(*(F.lit(x / scale) for x in entry)) for entry in b.tolist())) for b in books))
    return coded.withColumn("vector", F.flatten(F.transform("codes", lambda c, i: F.get(F.get(flat, i), c))))


def books_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(books_text(books).encode()).hexdigest()
