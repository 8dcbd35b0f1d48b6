"""The pipeline's stages on a whole small table."""

from collections import Counter

import corpus_pipeline
from larkspur.llm import line_dedup, quality, queries
from larkspur.session import shared_folder

SMALL = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = corpus_pipeline.run(spark, SMALL)
    got = {r.doc_id: r for r in out.collect()}
    assert set(docs.columns) <= set(out.columns)
    assert 0 < len(got) < docs.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in got.values())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontaminate", "bpe"]


def dropped_lines(docs):
    """The stage by brute force: the text of each document afterwards."""
    bare = lambda line: line.strip(line_dedup.BLANKS)
    pages = Counter(d.source for d in docs)
    on = Counter((d.source, x) for d in docs for x in {bare(line) for line in (d.text or "").split("\n")} - {""})
    common = {k for k, n in on.items() if n >= line_dedup.MIN_REPEATS and n / pages[k[0]] > corpus_pipeline.BOILERPLATE_RATIO}
    out = {}
    for d in docs:
        lines = (d.text or "").split("\n")
        kept = [x for x in lines if (d.source, bare(x)) not in common]
        out[d.doc_id] = "\n".join(kept) if any(map(bare, kept)) else d.text
    return out


def test_drop_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = [(k, "menu\nabout\nlegal\n" + f"own {k}") for k in range(6)] + [(6, "menu\n\nlegal")] + [(k, f"text {k}") for k in range(7, 20)]
    small = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in made], docs.schema)
    for given in (docs, small):
        rows = corpus_pipeline.drop_lines(spark, given, "").collect()
        got, expected = {r.doc_id: r.text for r in rows}, dropped_lines(given.collect())
        assert got == expected and all(r.n_chars == len(r.text) for r in rows if r.text is not None)
    assert got[0] == "own 0" and got[6] == "menu\n\nlegal"


def test_a_line_is_judged_alike_on_all_sources(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "source", "text")
    left = line_dedup.lines_of(corpus_pipeline.drop_lines(spark, docs.withColumn("n_chars", docs.doc_id), ""), "doc_id", "source", "text").groupBy("key").count()
    before = line_dedup.lines_of(docs, "doc_id", "source", "text").groupBy("key").count()
    changed = before.withColumnRenamed("count", "n").join(left, "key", "left").na.fill(0, ["count"]).where("n != count").collect()
    assert [(r.n, r["count"]) for r in changed] == [(1061, 0)]


def test_a_run_leaves_its_result_alone(spark, tmp_path_factory):
    """What stages save in between goes with them."""
    import os

    folder = shared_folder(spark).removeprefix("file:")
    held = lambda: set(os.listdir(f"{folder}/tables/{spark.sparkContext.applicationId}")) if os.path.isdir(f"{folder}/tables/{spark.sparkContext.applicationId}") else set()
    before, runs = held(), {x for x in os.listdir(folder) if x.startswith("pipeline-")}
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert held() == before and out.count() > 0
    (own,) = {x for x in os.listdir(folder) if x.startswith("pipeline-")} - runs
    assert os.listdir(f"{folder}/{own}") == ["4-bpe"]


def test_stages_keep_what_their_operators_judge_good(spark):
    """Quality and decontamination as stages against the verdicts of their operators, which are held by brute force; ids of the last stage against the library."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(corpus_pipeline.keep_quality(spark, docs, SMALL)) == ids(quality.assess(docs).where("kept"))
    assert ids(corpus_pipeline.drop_contaminated(spark, docs, SMALL)) == ids(queries.op5_decontaminate(spark, SMALL).where("NOT contaminated"))
    library = Tokenizer.from_file(corpus_pipeline.BYTE_BPE)
    library.no_truncation()
    library.no_padding()
    for r in corpus_pipeline.encode(spark, docs, SMALL).collect():
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.round_trip
