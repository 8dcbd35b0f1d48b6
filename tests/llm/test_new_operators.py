"""Merkle manifests, weighted-sampling fingerprints and vector codes against brute force, on odd rows and against SQL."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from larkspur.llm import merkle, queries, vector_codes, weighted_sampling
from larkspur.session import Scratch, clear, shared_folder

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
LONG = "word " * 200_000


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, name):
    assert compare(spark, connect(SMALL), queries.QUERIES[name], queries.ORACLES[name], SMALL) == ""


# Merkle


def tree(nodes):
    """The root and each node's siblings, level by level."""
    proofs, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, j in enumerate(places):
            run = j // 3 * 3
            proofs[i] += [x for k, x in enumerate(nodes[run : run + 3]) if run + k != j]
            places[i] = j // 3
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], proofs


def by_hand(rows):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for r in rows:
        groups.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, sha("".join(value(r[c]) for c in COLUMNS)), r.doc_id))
    own = [(sorted(groups[g]), *tree([x[2] for x in sorted(groups[g])])) for g in sorted(groups, key=lambda g: (g is not None, (g or "").encode()))]
    root, above = tree([x[1] for x in own])
    return sorted((str(leaf[3]), leaf[2], sub, root, "".join(p + top)) for (leaves, sub, proofs), top in zip(own, above, strict=True) for leaf, p in zip(leaves, proofs, strict=True))


ODD = [(k, f"s{k % 3}", "en", k, f"text\n{k}") for k in range(31)] + [(None, "s1", None, None, None), (None, "s1", None, None, None), (7, "s1", "en", 1, ""), (7, "s1", "en", 1, ""), (8, None, "é", 2, "東京"), (9, "", "x", 3, LONG)]


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest(spark, levels):
    docs = spark.createDataFrame(ODD, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit(1) for c in ("tree", "place", "node", "key", "proof", "root", "Block")})
    with Scratch(spark) as scratch:
        rows = merkle.manifest(scratch, docs, COLUMNS, key="doc_id", group="source", levels=levels)
        got = rows.select("*", merkle.siblings(F.col("proof")).alias("all"), merkle.fold(F.col("leaf"), F.col("proof")).alias("folded")).collect()
        assert merkle.manifest(scratch, docs.limit(0), COLUMNS, key="doc_id", group="source").count() == 0
    assert sorted((str(r.key), r.leaf, r.subroot, r.root, r.all) for r in got) == by_hand(docs.collect())
    assert all(r.folded == r.root for r in got)


def test_one_row_is_its_own_root(spark):
    with Scratch(spark) as scratch:
        row = merkle.manifest(scratch, spark.createDataFrame([ODD[0]], "doc_id long, source string, lang string, n_chars long, text string"), COLUMNS, key="doc_id", group="source").first()
    assert row.leaf == row.subroot == row.root and row.proof == []


def test_changed_rows_are_told(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, source string, lang string, n_chars long, text string")
    with Scratch(spark) as scratch:
        kept = scratch.save(merkle.manifest(scratch, docs, COLUMNS, key="doc_id", group="source"))
        now = docs.where("doc_id IS NULL OR doc_id <> 3").withColumn("text", F.when(F.col("doc_id") == 5, "other").otherwise(F.col("text"))).unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.lit(99).cast("long")))
        assert sorted((r.key, r.reason) for r in merkle.changed(now, kept, COLUMNS, key="doc_id").collect()) == [(3, "gone"), (5, "changed"), (99, "new")]


# Weighted sampling


def bag(text):
    return Counter(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def similarity(one, two):
    a, b = bag(one), bag(two)
    return sum(min(a[x], b[x]) for x in a | b) / max(1, sum(max(a[x], b[x]) for x in a | b))


def test_fingerprints(spark):
    """Every row by hand; the share of equal samples is the generalised Jaccard similarity within the error of 128 draws."""
    docs = pq.read_table(f"{SMALL}/documents.parquet").sort_by([("doc_id", "descending")]).to_pydict()
    got = {r.doc_id: r for r in queries.op12_fingerprints(spark, SMALL).collect()}
    texts = docs["text"]
    errors = []
    for i, key in enumerate(docs["doc_id"]):
        own, after, r = texts[i] or "", texts[(i + 1) % len(texts)] or "", got[key]
        m = len(own) // 3
        edited = own[: len(own) - m] + after[:m]
        assert (r.n_chars, r.edited_sha256) == (len(own), sha(edited))
        same = lambda x, y: sum(x[k : k + 4] == y[k : k + 4] for k in range(0, len(x), 4)) / (len(x) / 4)
        assert r.near_edited == same(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == same(r.fingerprint, got[docs["doc_id"][(i + 1) % len(texts)]].fingerprint)
        errors += [r.near_edited - similarity(own, edited), r.near_next - similarity(own, after)]
    assert len(got) == len(texts) and np.abs(errors).max() < 0.25 and np.abs(errors).mean() < 0.04 and abs(np.mean(errors)) < 0.01


def test_signatures_by_single_draws():
    """A signature is the least of its terms' values, drawn one by one."""
    text = "a b b c c c d"
    terms = {}
    for block in weighted_sampling.words(__import__("pyarrow").array([text], __import__("pyarrow").large_string()), weighted_sampling.ALNUM, weighted_sampling.FOLD):
        for h in block.hashes.tolist():
            terms[h] = terms.get(h, 0) + 1
    values = np.stack([weighted_sampling.draw(np.array([h], np.uint64), np.array([n]), 128)[0] for h, n in terms.items()]).min(axis=0)
    bits = (weighted_sampling.mix(values.view(np.uint32).astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
    assert (np.maximum(bits, 1) == weighted_sampling.Sampler(128, 1).signatures([text])[0]).all()


def test_a_small_cache_gives_the_same(monkeypatch):
    texts = [r for r in pq.read_table(f"{SMALL}/documents.parquet")["text"].to_pylist()[:40]]
    whole = weighted_sampling.Sampler(32, 2).signatures(texts)
    monkeypatch.setattr(weighted_sampling, "CACHED", 1 << 14)
    again = weighted_sampling.Sampler(32, 2)
    assert all((again.signatures([t])[0] == w).all() for t, w in zip(texts, whole, strict=True))


def test_odd_texts(spark):
    rows = [(None, "null's row"), (1, None), (2, ""), (3, "!!! ???"), (4, "one two"), (5, "one two"), (5, "one two"), (6, LONG), (7, "é" * 100_000), (8, "One, TWO!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("key", "tie", "kind", "part", "own")})
    with Scratch(spark) as scratch:
        got = weighted_sampling.with_next(scratch, docs).collect()
        alone = weighted_sampling.with_next(scratch, docs.where("doc_id = 4")).collect()
        assert weighted_sampling.with_next(scratch, docs.limit(0)).count() == 0
    by_key = {r.key: r for r in got}
    assert len(got) == len(rows) and [r.n_chars for r in got if r.key == 5] == [7, 7]
    assert by_key[4].fingerprint == by_key[5].fingerprint == by_key[8].fingerprint != by_key[3].fingerprint  # signs and case are no part of words
    assert by_key[1].fingerprint == by_key[2].fingerprint == "0" * 512 and by_key[2].near_next == 1.0 and by_key[3].near_next == 0.0
    assert by_key[None].edited_sha256 == sha("null's " + "One")  # the last in order meets the first
    assert (alone[0].near_next, alone[0].edited_sha256) == (1.0, sha("one t" + "on"))
    own = weighted_sampling.fingerprint(docs, out="kind")
    assert own.columns[-1] == "kind" and {r.kind for r in own.where("doc_id = 5").collect()} == {by_key[5].fingerprint}
    pair = own.where("doc_id = 5").limit(1).select(F.col("kind").alias("a")).crossJoin(own.where("doc_id = 3").select(F.col("kind").alias("b")))
    assert pair.select(weighted_sampling.jaccard(F.col("a"), F.col("a")), weighted_sampling.jaccard(F.col("a"), F.col("b"))).first() == (1.0, 0.0)


# Vector codes


def codes_by_hand(rows, parts=8, entries=16, rounds=6):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = np.array([[int(np.floor(4096 * float(np.float32(x)))) for x in r[1]] for r in rows], np.int64)
    width, codes, errors, books = ints.shape[1] // parts, [], np.zeros(len(rows), np.int64), []
    for s in range(parts):
        own = ints[:, s * width : (s + 1) * width]
        book = own[:entries].copy()
        for turn in range(rounds + 1):
            far = ((own[:, None] - book[None]) ** 2).sum(axis=2)
            best = far.argmin(axis=1)
            if turn < rounds:
                for k in set(best.tolist()):
                    book[k] = [int(x) // int((best == k).sum()) for x in own[best == k].sum(axis=0)]
        codes.append(best)
        errors += far.min(axis=1)
        books += book.reshape(-1).tolist()
    return [(r[0], "".join(f"{c[n]:02x}" for c in codes), int(errors[n])) for n, r in enumerate(rows)], ",".join(map(str, books))


@pytest.mark.parametrize(("n", "hot"), [(300, 1000), (300, 3), (5, 1000)])
def test_codes(spark, n, hot):
    rng = np.random.default_rng(7)
    rows = [(k, rng.normal(size=16).astype(np.float32).tolist(), k % 3) for k in range(n)]
    rows += [(k + 1000, rows[0][1], None) for k in range(n // 3)] + [(2, rows[2][1], 2), (None, rows[1][1], 1)]
    bad = [(-5, None, 0), (-4, [], 0), (-3, [1.0] * 15, 0), (-2, [1.0] * 15 + [None], 0), (-1, [1.0] * 15 + [float("nan")], 0), (-6, [float("inf")] + [0.0] * 15, 0)]
    given = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("id", "vector", "row", "codes", "error", "cells")})
    expected, text = codes_by_hand(rows)
    with Scratch(spark) as scratch:
        out, books = vector_codes.compress(scratch, given, hot=hot)
        coded = scratch.save(out)
        got = vector_codes.label_errors(coded).collect()
        back = vector_codes.restore(coded.where("id = 3"), books).first()
    assert sorted((str(r.id), "".join(f"{c:02x}" for c in r.codes), r.error) for r in got) == sorted((str(i), c, e) for i, c, e in expected)
    assert vector_codes.books_text(books) == text
    total = Counter()
    for r in got:
        total[r.label] += r.error
    assert all(r.label_error == total[r.label] for r in got)
    near = np.floor(np.array(rows[3][1]) * 4096) - np.array(back.vector) * 4096
    assert int((near**2).sum()) == back.error


def test_no_vectors(spark):
    with Scratch(spark) as scratch:
        for rows in ([], [(1, None, 2)], [(1, [1.0, 2.0], 2)]):
            out, books = vector_codes.compress(scratch, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
            assert out.count() == 0 and books == []


def test_great_components_are_held(spark):
    rows = [(k, [3e38 if k == 2 else float(k)] * 8, 0) for k in range(20)]
    with Scratch(spark) as scratch:
        out, _ = vector_codes.compress(scratch, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
        assert min(r.error for r in out.collect()) >= 0


# Decontamination over blocks


def test_repeated_items_are_packed_into_blocks(spark):
    import os

    from larkspur.llm import decontaminate

    words = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    items = spark.createDataFrame([(k % 5, words(f"i{k % 5}x", 400)) for k in range(1000)] + [(9, words("big", 20_000))], "item_id long, text string")
    with Scratch(spark) as scratch:
        dealt, blocks = decontaminate._blocks(scratch, items, "item_id", "text", 8192)
        sizes = [r.n for r in dealt.groupBy("block").agg(F.sum(F.octet_length("words")).alias("n")).collect()]
        assert dealt.count() == 6 and len(blocks) == len(sizes) and max(sizes) <= 8192 + len(words("big", 20_000)) and sorted(sizes)[-2] <= 8192 + len(words("i0x", 400))
    docs = spark.createDataFrame([(k, "start " + words(f"i{k % 7}x", 30) + " end " + (words("big", 14) if k % 2 else "")) for k in range(40)] + [(50, None), (51, "")], "doc_id long, text string")
    clear(spark)
    find = lambda n: sorted(map(str, decontaminate.digest(decontaminate.find(docs, items, block_bytes=n)).collect()))
    assert find(8192) == find(1 << 30)
    left = os.listdir(f"{shared_folder(spark).removeprefix('file:')}/tables/{spark.sparkContext.applicationId}")
    assert len(left) <= 3  # the hits, and the running sizes
