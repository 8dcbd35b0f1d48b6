"""Near-duplicate documents: SuperMinHash signatures, banding, verification on full sets, union-find grouping.

A document's set holds the distinct shingles of its words (runs of anything but white space, A-Z in
lower case); a text of fewer words than a shingle is one shingle as a whole. Two documents are linked
where 100 * |A n B| >= percent * |A u B|, and a document's component is the smallest id it can reach.

* Rows with equal sets are one class from the start, found by a 128-bit sum over the set, so groups of
  copies never meet pair by pair.
* A class's signature is a SuperMinHash: every shingle takes a random permutation of the bins and puts
  step + fraction into them, the bins keep minima, and steps beyond the largest minimum are not taken.
  The marginals are those of MinHash, so P(a band of r bins agrees) is about J^r; with 35 bands of 5
  bins a pair at J = 0.8 is missed with a chance of 1e-6. The variance is lower than MinHash's. This is
  the only way a link can be missed: all pairs that share a bucket are decided exactly, as follows.
* Each bucket has a hub, its most central class: the one that shares the most buckets with the most
  others (ties: the smallest id). Every class is verified, on the full sets, with the most central of
  its hubs, then with those of its other hubs that are still in another component.
* Where a bucket is then still in several components, its members meet across components if that makes
  `partners` pairs a member at most.
* In larger buckets most such pairs are not links, and need not be made. Let D(x) be the symmetric
  difference of x and a reference r, the bucket's hub or the class that the hub is linked to. |A - B| +
  |B - A| = |D(a)| + |D(b)| - 2 |D(a) n D(b)|, and a and b are linked where that is at most c (|A| + |B|),
  c = (100 - percent) / (100 + percent). If a is not linked to r, |D(a)| > c (|A| + |R|), so a link of a
  and b needs |D(a) n D(b)| > (|D(b)| - c (|B| - |R|)) / 2: about half of what tells b from r must be in D(a)
  as well. So b takes from D(b) what the D of any other such a holds, and meets those a that share one
  of its rarest elements, as many as leave too few others (prefix filtering). Pairs that meet are
  decided on the differences. Members that are linked to r both are in one component anyway.
* Links are contracted by union-find in tasks of a bounded number of links, then across tasks by
  alternately hooking to and jumping over smaller neighbours.

Null and blank texts have empty sets and are linked with nothing. Equal rows are returned as often as
they occur, with equal results. Rows that share an id but not their text are one node: it is linked if
any of its texts is. A row with a null id gets a null component and is kept. Ids are integers or
strings (ordered as text). Ties among hubs go to the smallest id. An empty table gives an empty result.
Very long texts are hashed a block at a time. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from larkspur.session import Scratch, saved, unused

from .wordhash import NOT_SPACE, U, mix, windows, words

WORDS, PERCENT, BANDS, ROWS = 5, 80, 35, 5
#: The members left in a bucket meet across components if that makes so many pairs a member at most.
PARTNERS = 8
#: Pairs of one class that meet its set in one task; a class of more pairs is dealt over several.
PAIRS_PER_TASK = 256
#: Links that one task contracts at a time.
LINKS_PER_TASK = 1 << 18
_ELEMENTS = 1 << 17


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of documents: their places, sorted distinct shingle hashes one document after the other, and the bounds of each."""
    for block in words(texts, NOT_SPACE):
        owner, counts = block.owner(), block.counts
        starts, hashes = windows(block.hashes, owner, size)
        owner = owner[starts]
        for k in np.flatnonzero((counts > 0) & (counts < size)):
            a, b = block.bounds[k : k + 2]
            whole = windows(block.hashes[a:b], np.zeros(b - a, np.int8), int(b - a))[1] ^ U(int(b - a))
            hashes, owner = np.append(hashes, whole), np.append(owner, k)
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[fresh], owner[fresh]
        yield block.docs, hashes, np.searchsorted(owner, np.arange(len(block.docs) + 1))


def super_minhash(hashes: np.ndarray, bounds: np.ndarray, bins: int) -> np.ndarray:
    """Signatures of the sets between the bounds. bins: 255 at most.

    All elements of a block take their step j together: an element draws its j-th bin by the j-th
    swap of a Fisher-Yates shuffle and offers j + fraction, as 8 and 24 bits. A set is done once all
    its minima are below j.
    """
    n_sets = len(bounds) - 1
    out = np.full((n_sets, bins), 0xFFFFFFFF, np.uint32)
    sizes = np.diff(bounds)
    first = 0
    while first < n_sets:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + _ELEMENTS, "right")) - 1)
        for at in range(int(bounds[first]), int(bounds[last]), _ELEMENTS) if last == first + 1 else [int(bounds[first])]:
            to = min(at + _ELEMENTS, int(bounds[last])) if last == first + 1 else int(bounds[last])
            owner = np.zeros(to - at, np.int64) if last == first + 1 else np.repeat(np.arange(last - first), sizes[first:last])
            _offer(out[first:last], hashes[at:to], owner, bins)
        first = last
    return out


def _offer(out: np.ndarray, elements: np.ndarray, owner: np.ndarray, bins: int) -> None:
    flat = out.reshape(-1)
    bin_of = np.empty((len(elements), bins), np.uint8)
    bin_of[:] = np.arange(bins, dtype=np.uint8)
    rows = np.arange(len(elements))
    for j in range(bins):
        draw = mix(elements + U(j) * U(0xA24BAED4963EE407))
        k = j + ((draw >> U(40)) * U(bins - j) >> U(24)).astype(np.int64)
        taken = bin_of[rows, k]
        bin_of[rows, k] = bin_of[rows, j]
        value = (U(j) << U(24) | (draw & U(0xFFFFFF))).astype(np.uint32)
        np.minimum.at(flat, owner * bins + taken, value)
        open_sets = out.max(axis=1) >= ((j + 1) << 24)
        if not open_sets.any():
            return
        go_on = open_sets[owner]
        if not go_on.all():
            elements, owner, bin_of = elements[go_on], owner[go_on], bin_of[go_on]
            rows = np.arange(len(elements))


def _class_sums(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(mix(hashes ^ U(salt)), out=sums[1:])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def sketch(documents: DataFrame, doc_id: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, the class as two sums, and the bands' bucket keys."""

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            for docs, hashes, bounds in shingle_sets(batch.column(1), size):
                signature = super_minhash(hashes, bounds, bands * rows).astype(np.uint64).reshape(len(docs), bands, rows)
                key = np.broadcast_to(salts, (len(docs), bands))
                for r in range(rows):
                    key = mix(key ^ signature[:, :, r])
                one, two = _class_sums(hashes, bounds)
                counts = np.diff(bounds)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(docs) + 1) * bands, pa.int32()), pa.array(key.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs)), pa.array(counts, pa.int64()), pa.array(one), pa.array(two), keys], ["doc_id", "n_shingles", "class_a", "class_b", "bands"])

    kind = id_kind(documents, doc_id)
    own = documents.select(F.col(doc_id).cast(kind).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(sketched, f"doc_id {kind}, n_shingles long, class_a long, class_b long, bands array<long>")


def id_kind(documents: DataFrame, doc_id: str) -> str:
    """The type that ids are compared in."""
    return "long" if isinstance(documents.schema[doc_id].dataType, IntegralType) else "string"


class Texts:
    """The texts of documents by id, and the shingle sets made of them."""

    def __init__(self, documents: DataFrame, doc_id: str, text: str, size: int, scratch: Scratch):
        self.scratch = scratch
        self.rows = documents.select(F.col(doc_id).cast(id_kind(documents, doc_id)).alias("doc"), F.col(text).cast("string").alias("text"))
        self.size = size

    def keep(self, ids: DataFrame) -> None:
        """Go on from the texts of these ids only, written once: all texts move here, and no more after that."""
        self.rows = self.scratch.save(self.rows.join(ids.select(F.col("id").alias("doc")).distinct().hint("merge"), "doc", "left_semi"))

    def sets(self, wanted: DataFrame, key: str, name: str) -> DataFrame:
        """wanted, with the sets of the documents of its column key in a column of that name."""
        met = self.rows.join(wanted.hint("merge"), F.col("doc") == F.col(key)).select("text", *wanted.columns)
        size = self.size

        def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for docs, hashes, bounds in shingle_sets(batch.column(0), size):
                    sets = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(hashes.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([*(c.take(pa.array(docs)) for c in batch.columns[1:]), sets], [*batch.schema.names[1:], name])

        return met.mapInArrow(built, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in wanted.schema), f"{name} array<long>"]))

    def facing(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, ...) with their sets, left and right. Pairs of an a with many b are dealt over several tasks."""
        tasks = self.scratch.save(pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_PER_TASK).cast("int").alias("tasks")))
        salted = self.scratch.save(pairs.join(tasks, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int")).drop("tasks"))
        left = self.sets(tasks, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
        return self.sets(salted, "b", "right").join(left, ["a", "salt"]).where((F.size("left") > 0) & (F.size("right") > 0))


def verify(pairs: DataFrame, texts: Texts, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar enough."""
    shared = F.size(F.array_intersect("left", "right"))
    sizes = F.size("left") + F.size("right")
    close = F.least(F.size("left"), F.size("right")) * 100 >= F.greatest(F.size("left"), F.size("right")) * percent
    return texts.facing(pairs).where(close).where(shared * 100 >= (sizes - shared) * percent).select("a", "b").distinct()


def differing(members: DataFrame, texts: Texts, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join the members (a reference a, b, component) of one reference wherever a link between components does, by their differences from it."""
    far, near = 100 + percent, 100 - percent
    # r tells the texts of a reference apart, should rows share its id
    of = ["a", "r"]
    both = texts.facing(members).select("a", F.xxhash64("left").alias("r"), "b", "component", F.size("left").alias("h"), F.size("right").alias("n"), F.concat(F.array_except("left", "right"), F.array_except("right", "left")).alias("delta"))
    deltas = scratch.save(both.withColumn("d", F.size("delta")))
    is_loose = F.col("d") * far > (F.col("n") + F.col("h")) * near
    marks = deltas.where(is_loose).select(*of, F.explode("delta").alias("e"), F.col("b").alias("x"), F.col("component").alias("x_component"), F.col("n").alias("x_n"), F.col("d").alias("x_d"))
    held = marks.groupBy(*of, "e").agg(F.count("*").alias("m"), F.min("x").alias("one"))
    hits = deltas.select(*of, "b", "component", "n", "h", "d", F.explode("delta").alias("e")).join(held, [*of, "e"]).where((F.col("m") > 1) | (F.col("one") != F.col("b")))
    needed = F.floor((F.col("d") * far - (F.col("n") - F.col("h")) * near) / (2 * far)).cast("int") + 1
    own = hits.groupBy(*of, "b", "component", "n", "h", "d").agg(F.sort_array(F.collect_list(F.struct("m", "e"))).alias("hits")).withColumn("first", F.size("hits") - needed + 1)
    rarest = own.where(F.col("first") > 0).select(*of, "b", "component", "n", "d", F.explode(F.slice("hits", F.lit(1), F.col("first"))).alias("hit")).withColumn("e", F.col("hit.e"))
    may_link = (F.col("x_component") != F.col("component")) & (F.abs(F.col("x_d") - F.col("d")) * far <= (F.col("x_n") + F.col("n")) * near)
    pairs = rarest.join(marks, [*of, "e"]).where(may_link).select(*of, F.least("x", "b").alias("b"), F.greatest("x", "b").alias("c")).distinct()
    other = deltas.select(*of, F.col("b").alias("c"), F.col("n").alias("other_n"), F.col("delta").alias("other"))
    met = pairs.join(deltas.select(*of, "b", "n", "delta"), [*of, "b"]).join(other, [*of, "c"])
    distance = F.size("delta") + F.size("other") - 2 * F.size(F.array_intersect("delta", "other"))
    links = met.where(distance * far <= (F.col("n") + F.col("other_n")) * near).select(F.col("b").alias("a"), F.col("c").alias("b"))
    return links.unionByName(deltas.where(~is_loose).select("a", "b")).distinct()


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition: each node that is not a root, with its root, the smallest id."""
    parent: dict = {}
    kind = None

    def root(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for k in range(0, len(nodes), 1 << 16):
        part = nodes[k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([root(x) for x in part], kind)], ["node", "root"])


def _contracted(links: DataFrame, per_task: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """Edges (node, root) of the forests of tasks with about so many links each, and the number of tasks."""
    tasks = -(-links.count() // per_task) or 1
    kind = links.schema[0].dataType.simpleString()
    return scratch.save(links.toDF("node", "root").coalesce(tasks).mapInArrow(_forest, f"node {kind}, root {kind}")), tasks


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one root, and no root is a node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("node").alias("x"), F.lit(1).alias("n")), F.struct(F.col("root").alias("x"), F.lit(0).alias("n")))).alias("e")).select("e.*")
    roles = ends.groupBy("x").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    return roles.where((F.col("n") > 1) | ((F.col("n") == 1) & (F.col("least") == 0))).isEmpty()


def components(links: DataFrame, scratch: Scratch, per_task: int = LINKS_PER_TASK) -> DataFrame:
    """node and component, the smallest id that it can reach, of all nodes of links (a, b) that are not the smallest themselves."""
    edges, tasks = _contracted(links.select("a", "b"), per_task, scratch)
    while tasks > 1 and not _are_stars(edges):
        # every node's larger neighbours hook to its smallest neighbour, then all of its smaller ones do
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("low"))
        large = both.join(least, "node").where(F.col("root") > F.col("node")).select(F.col("root").alias("node"), F.least("low", "node").alias("root"))
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(low, "node")
        rest = small.where(F.col("root") != F.col("low")).select(F.col("root").alias("node"), F.col("low").alias("root"))
        edges, tasks = _contracted(scratch.save(rest.unionByName(small.select("node", F.col("low").alias("root"))).distinct()), per_task, scratch)
    return edges.select("node", F.col("root").alias("component"))


def _labelled(rows: DataFrame, key: str, found: DataFrame, name: str) -> DataFrame:
    """rows with the components of the ids in key, in a column of that name."""
    own = found.select(F.col("node").alias(key), F.col("component").alias("_own"))
    return rows.join(own.hint("merge"), key, "left").withColumn(name, F.coalesce("_own", key)).drop("_own")


def grouped(sketches: DataFrame, texts: Texts, percent: int, scratch: Scratch, *, partners: int = PARTNERS, per_task: int = LINKS_PER_TASK) -> DataFrame:
    """node and component of the classes' smallest ids, as far as they are not their own component."""
    alike = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    verified = lambda pairs: verify(scratch.save(pairs), texts, percent)
    full = sketches.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = full.groupBy("class_a", "class_b").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"))
    entries = classes.select("id", "size", F.explode("bands").alias("bucket"))
    shared = scratch.save(entries.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1))
    # What these joins meet grows with the documents, so it is never broadcast, and the plan is the same at every size.
    met = scratch.save(entries.join(shared.hint("merge"), "bucket"))
    texts.keep(met)
    rank = met.groupBy("id").agg((-F.sum("n")).alias("rank"))
    hubs = met.join(rank.hint("merge"), "id").groupBy("bucket").agg(F.min(F.struct("rank", F.col("id").alias("hub"), F.col("size").alias("hub_size"))).alias("first"))
    stars = scratch.save(met.join(hubs.hint("merge"), "bucket").where(F.col("id") != F.col("first.hub")).select("bucket", "n", "id", "size", "first"))
    # the most central hub of each class
    best = stars.groupBy("id", "size").agg(F.min("first").alias("first"))
    links = scratch.save(verified(best.where(alike(F.col("size"), F.col("first.hub_size"))).select(F.col("first.hub").alias("a"), F.col("id").alias("b"))))
    tops = links
    found = components(links, scratch, per_task)
    # its other hubs, as far as they are in other components
    others = stars.where(alike(F.col("size"), F.col("first.hub_size"))).select(F.col("first.hub").alias("a"), F.col("id").alias("b")).distinct()
    others = others.join(best.select(F.col("id").alias("b"), F.col("first.hub").alias("best")).hint("merge"), "b").where(F.col("a") != F.col("best"))
    across = _labelled(_labelled(others, "a", found, "c_a"), "b", found, "c_b").where(F.col("c_a") != F.col("c_b")).select("a", "b")
    links = scratch.save(links.unionByName(verified(across)))
    found = components(links, scratch, per_task)
    # A bucket's hub has met all others. Those left meet each other if they are in several components.
    known = _labelled(stars.where(F.col("n") > 2).select("bucket", "id", "size", F.col("first.hub").alias("hub")), "id", found, "component")
    parts = known.groupBy("bucket", "component").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("same"))
    pairs_left = (F.col("n") * F.col("n") - F.col("same")) / 2
    apart = scratch.save(known.join(parts.where(pairs_left > 0).select("bucket", (pairs_left <= F.col("n") * partners).alias("few")).hint("merge"), "bucket"))
    few = apart.where("few")
    other = few.select("bucket", F.col("id").alias("a"), F.col("size").alias("a_size"), F.col("component").alias("other"))
    met_in = few.join(other, "bucket").where((F.col("a") < F.col("id")) & (F.col("other") != F.col("component")) & alike(F.col("size"), F.col("a_size")))
    links = scratch.save(links.unionByName(verified(met_in.select("a", F.col("id").alias("b")).distinct())))
    many = apart.where(~F.col("few"))
    if not many.isEmpty():
        found = components(links, scratch, per_task)
        many = many.drop("component").join(tops.select(F.col("b").alias("hub"), F.col("a").alias("top")), "hub", "left").select(F.coalesce("top", "hub").alias("a"), F.col("id").alias("b")).distinct()
        members = scratch.save(_labelled(many, "b", found, "component"))
        links = scratch.save(links.unionByName(differing(members, texts, percent, scratch)))
    return components(links, scratch, per_task)


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words_per_shingle: int = WORDS, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, **limits: int) -> DataFrame:
    """Per row of documents: doc_id, n_shingles, component_id and kept (doc_id = component_id). Tables in between are deleted."""
    with Scratch(documents.sparkSession) as scratch:
        sketches = scratch.save(sketch(documents, doc_id, text, words_per_shingle, bands, rows))
        found = grouped(sketches, Texts(documents, doc_id, text, words_per_shingle, scratch), percent, scratch, **limits)
        one = sketches.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()).groupBy("class_a", "class_b").agg(F.min("doc_id").alias("node"))
        named = _labelled(one, "node", found, "component").drop("node")
        out = sketches.select("doc_id", "n_shingles", "class_a", "class_b").join(named.hint("merge"), ["class_a", "class_b"], "left")
        component = F.coalesce("component", "doc_id")
        return saved(out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))


def deduplicate(documents: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """documents without those whose component has a smaller id; all columns are kept."""
    gone = unused("gone", documents.columns)
    ids = near_duplicates(documents, doc_id=doc_id, **options).where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return documents.join(ids, F.col(doc_id).cast(id_kind(documents, doc_id)) == F.col(gone), "left_anti")
