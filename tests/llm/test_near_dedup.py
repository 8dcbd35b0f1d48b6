"""Near-duplicate groups against comparing every pair."""

import random
import re

import duckdb
import numpy as np
import pytest

from larkspur.llm import near_dedup
from larkspur.session import Scratch

SMALL = "/root/testdata/sf0.01"


def shingles(text, size):
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute(rows, size, percent=80):
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for k, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    for k, s in enumerate(sets):
        near = {j for x in s for j in where[x] if j < k}
        for j in near:
            both = len(s & sets[j])
            if both * 100 >= percent * (len(s) + len(sets[j]) - both):
                parent[root(k)] = root(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return {i: (len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows)}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("size", [2, 5])
def test_whole_table(spark, size):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert result(near_dedup.near_duplicates(docs, words_per_shingle=size)) == brute(rows, size)


def test_families_around_a_hidden_centre(spark):
    rng = random.Random(5)
    rows = []
    for family in range(4):
        base = [f"w{family}_{rng.randrange(400)}" for _ in range(120)]
        for _ in range(60):
            own = list(base)
            for _ in range(rng.randrange(1, 12)):
                own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) * 7 % 1009, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(rows, 2)
    assert result(near_dedup.near_duplicates(docs, words_per_shingle=2)) == expected
    # small limits: all buckets go by differences, and links are contracted over many tasks
    assert result(near_dedup.near_duplicates(docs, words_per_shingle=2, partners=0, per_task=16)) == expected


def test_edges(spark):
    rows = [(1, "a b c"), (2, "A  b\nc"), (3, None), (4, ""), (5, " \t"), (6, "a"), (7, "A"), (None, "a b c"), (8, "a b c"), (8, "a b c")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, words_per_shingle=2).collect()), key=str)
    expected = [(1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False), (None, 2, None, True), (8, 2, 1, False), (8, 2, 1, False)]
    assert got == sorted(expected, key=str)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200).astype(np.uint64)])
    both = near_dedup.super_minhash(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 1000, 2000]), 200)
    assert abs((both[0] == both[1]).mean() - 800 / 1200) < 0.12


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(100, 300)] + [(1, 5), (5, 9), (9, 1)], "a long, b long")
    with Scratch(spark) as scratch:
        got = {r.node: r.component for r in near_dedup.components(links, scratch, per_task=8).collect()}
    assert got == {k: 100 for k in range(101, 301)} | {5: 1, 9: 1}
