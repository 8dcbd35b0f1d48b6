"""Merkle manifests of datasets, reduced by superblocks.

Every row is a leaf of the tree of its group (its source); the roots of the groups are the leaves of one
more tree, whose root stands for the whole table. In a tree every `fanout` consecutive nodes, and the
fewer ones that are left at its end, become the hash of their concatenated hex digests, until one is left.

Leaves get their place by a sort by ranges: places within a range come from the sort, a group's offset in
a range from the sizes of the ranges before it, so no task holds a group. Then places are dealt into
superblocks of fanout^levels, and applyInPandas collapses that many levels of a superblock at once, which
gives its root and, for each of its nodes, the lower part of the proof. The superblocks' roots are the
nodes of the next round, a fanout^levels-th as many. Going back, the proof of a superblock is put behind
those of its nodes: joins by superblock, of which none holds more than fanout^levels rows.

A proof is a list of steps from the leaf to the root; `before` and `after` are the digests of the run's other
nodes on either side. `fold` recomputes the root from a leaf and its proof, natively.

Nulls: a null column is hashed as `-`; a null group is a group of its own, before all others; a null key
comes before all others in its group. Rows of equal keys are ordered by their leaves, so that of equal rows
it does not matter which comes first; each keeps its own proof. Texts are hashed whole. A group of one row
has the leaf as its root; an empty table has no leaves and an empty manifest. Only the columns that are named
are hashed, and the result has columns of its own, so other columns, whatever their names, are of no effect.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import Scratch

FANOUT = 3
#: Levels that a superblock collapses: 729 nodes of fan-out 3.
LEVELS = 6
_SINGLE = 1 << 33  # monotonically_increasing_id counts rows within a partition up to this


def leaf(values: Sequence[Column]) -> Column:
    """The hash of a row: of each value its size in bytes, a colon and itself, or `-` where it is null."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*map(one, values)), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""
    return F.aggregate(proof, start, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def siblings(proof: Column) -> Column:
    """All digests of a proof, from the leaf to the root and from left to right, as one text."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")


def _placed(scratch: Scratch, rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows (tree, ...) with their place in their tree, from 0, and the tree's size."""
    ranged = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = scratch.save(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.floor(F.col("_at") / _SINGLE)))
    parts = ranged.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    own = Window.partitionBy("tree")
    before = F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("tree", "_part", (before - F.col("_first")).alias("_offset"), F.sum("_n").over(own).alias("n"))
    return ranged.join(parts, ["tree", "_part"]).withColumn("place", F.col("_at") + F.col("_offset")).drop("_at", "_part", "_offset")


def collapse(nodes: list[str], levels: int, fanout: int) -> tuple[str, list[list[str]], list[list[str]]]:
    """The root of a superblock after so many levels, and for each node the digests before and after it on its way."""
    before: list[np.ndarray] = []
    after: list[np.ndarray] = []
    place = np.arange(len(nodes))
    for _ in range(levels):
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        left = np.array(["".join(r[:i]) for r in runs for i in range(len(r))], object)
        right = np.array(["".join(r[i + 1 :]) for r in runs for i in range(len(r))], object)
        before.append(left[place])
        after.append(right[place])
        nodes = [hashlib.sha256("".join(r).encode()).hexdigest() for r in runs]
        place = place // fanout
    if not levels:
        return nodes[0], [[] for _ in place], [[] for _ in place]
    return nodes[0], [list(x) for x in zip(*before, strict=True)], [list(x) for x in zip(*after, strict=True)]


def _collapser(levels: int, fanout: int, carried: list[str]):
    size = fanout**levels

    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("place")
        n, depth = int(block["n"].iloc[0]), 0
        while depth < levels and fanout**depth < n:
            depth += 1
        root, before, after = collapse(block["node"].tolist(), depth, fanout)
        return block[["tree", "place", "node", *carried]].assign(block=key[1], n=-(-n // size), top=root, before=before, after=after)

    return run


def _rounds(scratch: Scratch, nodes: DataFrame, carried: list[str], levels: int, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The superblocks of each round, from the leaves (tree, place, n, node, carried ones) up, and the root of each tree."""
    rounds: list[DataFrame] = []
    while True:
        own = [] if rounds else carried
        kinds = ", ".join(["tree string, place long, node string", *(f"{c} {dict(nodes.dtypes)[c]}" for c in own), "block long, n long, top string, before array<string>, after array<string>"])
        block = F.floor(F.col("place") / F.lit(fanout**levels)).alias("block")
        rounds.append(scratch.save(nodes.groupBy("tree", block).applyInPandas(_collapser(levels, fanout, own), kinds)))
        nodes = rounds[-1].where(F.col("place") % F.lit(fanout**levels) == 0).select("tree", F.col("block").alias("place"), "n", F.col("top").alias("node"))
        if nodes.where("n > 1").isEmpty():
            return rounds, nodes


def _back(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The nodes of the first round with their whole proofs and what else is said of the roots of their trees (tree, block, proof, ...)."""
    for k, own in reversed(list(enumerate(rounds))):
        proof = F.concat(F.arrays_zip("before", "after"), "proof").alias("proof")
        said = [c for c in above.columns if c not in ("tree", "block", "proof")]
        kept = [c for c in own.columns if c not in ("tree", "place", "block", "n", "top", "before", "after")] if not k else []
        above = own.join(above, ["tree", "block"]).select("tree", F.col("place").alias("block"), *kept, *said, proof)
    return above


def manifest(scratch: Scratch, docs: DataFrame, columns: Sequence[str], *, key: str, group: str, other: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """A row for each of docs: key, leaf (the hash of columns), subroot (of its group), root (of all), proof, and other, which is carried along.

    The result reads tables of scratch, so it must be written before these are deleted.
    """
    name = lambda c: F.col(f"`{c}`")
    kept = [name(key).alias("key"), (F.lit(None).cast("string") if other is None else other).alias("other")]
    leaves = docs.select(F.coalesce(F.concat(F.lit("="), name(group).cast("string")), F.lit("")).alias("tree"), leaf([name(c) for c in columns]).alias("node"), *kept)
    none = F.array().cast("array<struct<before:string,after:string>>")
    placed = _placed(scratch, leaves, [F.col("key").asc_nulls_first(), F.col("node")])
    rounds, roots = _rounds(scratch, placed, ["key", "other"], levels, fanout)
    tops, root = _rounds(scratch, _placed(scratch, roots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), "node"), [F.col("own")]), ["own"], levels, fanout)
    above = _back(tops, root.select("tree", F.col("place").alias("block"), F.col("node").alias("root"), none.alias("proof")))
    above = above.select(F.col("own").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("node").alias("subroot"), "root", "proof")
    return _back(rounds, above).select("key", F.col("node").alias("leaf"), "subroot", "root", "proof", "other")


def changed(docs: DataFrame, kept: DataFrame, columns: Sequence[str], *, key: str) -> DataFrame:
    """Keys of a written manifest whose rows are gone or no longer give its root, and of docs that it lacks: key and reason (changed, gone, new).

    Nulls and repeated keys: a row counts as unchanged if any row of the manifest with its key has its leaf.
    """
    name = lambda c: F.col(f"`{c}`")
    now = docs.select(name(key).alias("key"), leaf([name(c) for c in columns]).alias("_leaf")).distinct()
    before = kept.groupBy("key").agg(F.collect_set("leaf").alias("_leaves"), F.min(fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("_sound"))
    both = now.withColumn("_here", F.lit(True)).join(before.withColumn("_kept", F.lit(True)), now["key"].eqNullSafe(before["key"]), "full")
    reason = F.when(F.col("_kept").isNull(), "new").when(F.col("_here").isNull(), "gone").when(~F.col("_sound") | ~F.array_contains("_leaves", F.col("_leaf")), "changed")
    return both.select(F.coalesce(now["key"], before["key"]).alias("key"), reason.alias("reason")).where("reason IS NOT NULL").distinct()
