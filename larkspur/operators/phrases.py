"""Many phrases in one pass over a text.

Phrases are put in automata, tries with failure links, which find every occurrence of every phrase of theirs in a single pass whatever the number of phrases.
The phrase that counts is the first in list order of those found, as with `filters.denied_phrase` and `filters.matched_phrase`, which try each phrase on each row and so suit short lists.

A long list is cut, in its order, into blocks of about `BLOCK_BYTES`, written as files, of which a worker holds one at a time; neither driver nor
workers hold the list. A text in which a phrase of the first block is found is done. The others are gathered, up to `GATHERED` characters, and go
through the blocks behind, each of which is thus built once for many texts.

Letters are compared in lower case. Empty and null phrases match nothing; of phrases that are equal in lower case the first counts. With
whole=True a phrase that begins with a letter or digit of ASCII does not match behind another one. A null text has no phrase; texts are read whole, of any length. An empty list
finds nothing, an empty table gives an empty one. Other columns stay, but for one called out, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import Scratch, saved
from larkspur.sources.files import opened

#: Bytes of phrases in an automaton, which takes some sixty times as much in a worker, and characters of texts that wait for the blocks behind the first.
BLOCK_BYTES, GATHERED = 2 << 20, 16 << 20
_BUILT: dict[str, tuple[ahocorasick.Automaton | None, list[str]]] = {}


def automaton(path: str) -> tuple[ahocorasick.Automaton | None, list[str]]:
    """The automaton of a block of phrases and the phrases as they are written; its values are their places in the block and their lengths in one number. A worker keeps the last one."""
    if path not in _BUILT:
        _BUILT.clear()
        files, own = opened(path)
        block = pq.read_table(own, filesystem=files, columns=["low", "phrase"])
        built = ahocorasick.Automaton()
        for place, low in enumerate(block.column("low").to_pylist()):
            built.add_word(low, place << 32 | len(low))
        if block.num_rows:
            built.make_automaton()
        _BUILT[path] = built if block.num_rows else None, block.column("phrase").to_pylist()
    return _BUILT[path]


def _word(char: str) -> bool:
    return char.isascii() and char.isalnum()


def first_found(built: ahocorasick.Automaton | None, text: str | None, whole: bool) -> int | None:
    """The least place of the phrases that a text in lower case holds."""
    if built is None or not text:
        return None
    best = None
    for end, value in built.iter(text):
        place, start = value >> 32, end - (value & 0xFFFFFFFF) + 1
        if (best is None or place < best) and not (whole and start and _word(text[start]) and _word(text[start - 1])):
            best = place
            if not place:
                break
    return best


def _searched(path: str, batch: pa.RecordBatch, whole: bool, out: str) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """A batch whose last column is texts in lower case: the rows in which a block's phrase is found, with it in place of the text, and the rows that are left."""
    built, written = automaton(path)
    places = [first_found(built, t.as_py(), whole) for t in batch.columns[-1]]
    found = pa.array([written[p] for p in places if p is not None], pa.string())
    held = pa.array([p is not None for p in places], pa.bool_())
    return pa.RecordBatch.from_arrays([*batch.filter(held).columns[:-1], found], [*batch.schema.names[:-1], out]), batch.filter(pc.invert(held))


def match(rows: DataFrame, phrases: DataFrame, *, text: str, out: str = "phrase", phrase: str = "phrase", pos: str = "pos", whole: bool = False, most_bytes: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rows with the first of the phrases (pos, phrase) that their text holds, as it is written in the list; null if none.

    A list of more than most_bytes, if that is given, is refused.
    """
    listed = phrases.select(F.col(pos).alias("pos"), F.col(phrase).alias("phrase"), F.lower(phrase).alias("low")).where(F.length("low") > 0)
    with Scratch(rows.sparkSession) as scratch:
        firsts = scratch.save(listed.groupBy("low").agg(F.min(F.struct("pos", "phrase")).alias("x")))
        size = firsts.agg(F.coalesce(F.sum(F.octet_length("low")), F.lit(0))).first()[0]
        if most_bytes is not None and size > most_bytes:
            raise ValueError(f"{size} bytes of phrases, more than {most_bytes}")
        cut = firsts.repartitionByRange(size // block_bytes + 1, "x").sortWithinPartitions("x").select("low", F.col("x.phrase").alias("phrase"))
        blocks = sorted(saved(cut).inputFiles(), key=lambda path: path.rsplit("/", 1)[1])  # files are numbered by ranges
    kept = [c for c in rows.columns if c != out]
    own = rows.select(*(F.col(f"`{c}`") for c in kept), F.lower(F.col(f"`{text}`")).alias("_low"))
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept), f"`{out}` string"])

    def behind(left: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in blocks[1:]:
            both = [_searched(path, batch, whole, out) for batch in left]
            yield from (found for found, _ in both if found.num_rows)
            left = [rest for _, rest in both if rest.num_rows]
        for batch in left:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.nulls(batch.num_rows, pa.string())], [*kept, out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, size = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1_000):
                found, rest = _searched(blocks[0], batch.slice(k, 1_000), whole, out) if blocks else (None, batch.slice(k, 1_000))
                if found is not None and found.num_rows:
                    yield found
                if rest.num_rows:
                    left.append(rest)
                    size += pc.sum(pc.utf8_length(rest.columns[-1])).as_py() or 0
                if size > GATHERED:
                    yield from behind(left)
                    left, size = [], 0
        yield from behind(left)

    return own.mapInArrow(run, kinds)
