"""Readers of files."""

import hashlib

import pyarrow as pa

from larkspur.sources import files, page_tree
from larkspur.sources.store import Store


def test_history(spark, tmp_path):
    (tmp_path / "h.csv").write_text('Applied T/F,Position (branch),Company,Platform Name,Referral,Callback T/F,Ghosted,Offer,Notes\n true ,dev,"A, Inc",AshbyHQ,FALSE,TRUE,,,"two\nlines"\nFALSE,x,B,lever,,,,,\nTRUE,known,C,lever,,,,,\nTRUE,dev,Z,lever,,,,,\n')
    known = spark.createDataFrame([("csv-import://known",)], "url string")
    got = files.import_history(files.history(spark, str(tmp_path / "h.csv")), known).collect()
    assert [(r.url, r.company, r.ats_platform, r.callback, r.referral, r.notes) for r in got] == [("csv-import://dev", "A, Inc", "ashby", 1, 0, "two\nlines")]


def test_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("---\nTitle: T\n---\nbody\n")
    (tmp_path / "b.txt").write_text("plain")
    (tmp_path / "c.bin").write_text("no")
    docs = files.corpus(spark, str(tmp_path))
    assert sorted((r.path.rsplit("/", 1)[1], r.meta.get("title"), r.body) for r in docs.collect()) == [("a.md", "T", "body\n"), ("b.txt", None, "plain")]
    before = files.fingerprint(docs).first()
    (tmp_path / "d.md").write_text("more")
    assert files.fingerprint(files.corpus(spark, str(tmp_path))).first() != before


def _tree(folder, n=200):
    """n notes in a folder, one more in a folder below it, and what no reader takes."""
    (folder / "sub" / "more").mkdir(parents=True)
    for k in range(n):
        (folder / f"f{k}.md").write_text(f"note {k}")
    (folder / "sub" / "more" / "a b%20c.txt").write_text("odd")
    (folder / "sub" / "empty.md").write_text("")
    (folder / "_hidden.md").write_text("no")
    (folder / ".hidden.md").write_text("no")


def test_many_files_are_listed_by_few_tasks(spark, tmp_path):
    """A file is no share of a task's size: 202 small files are few tasks. Names are taken as they are, and empty files, which Spark passes over, are files."""
    notes = tmp_path / "notes"
    _tree(notes)
    listed = files.listing(spark, str(notes))
    own = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,txt}").load(str(notes)).select("path", "modificationTime", "length")
    assert sorted(map(tuple, listed.where("length > 0").collect())) == sorted(map(tuple, own.collect())) and listed.count() == 202
    assert listed.rdd.getNumPartitions() < own.rdd.getNumPartitions()
    store = Store(spark, str(tmp_path / "store"))
    assert files.reload(store, str(notes)).count() == 202 and store.read().where("body = 'odd'").count() == 1
    files.delete_files(spark, str(notes))
    assert not notes.exists()
    notes.mkdir()
    assert files.reload(store, str(notes)).where("change = 'gone'").count() == 202


def test_texts_of_a_folder_with_hashes(spark, tmp_path):
    """Texts of all folders below are read, and many small ones by few tasks."""
    _tree(tmp_path / "texts")
    read = files.text_file(spark, str(tmp_path / "texts"))
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.sha256) for r in read.collect()}
    assert len(got) == 202 and got["a b%20c.txt"] == ("odd", hashlib.sha256(b"odd").hexdigest()) and got["empty.md"][0] == ""
    assert read.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_corpus_of_many_files(spark, tmp_path):
    """Many small notes are read by few tasks."""
    _tree(tmp_path / "notes")
    read = files.corpus(spark, str(tmp_path / "notes"))
    assert read.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(r.body for r in read.collect()) == sorted(["", "odd", *(f"note {k}" for k in range(200))])


def test_pages_are_handed_on_a_few_at_a_time():
    """A batch of many pages is not held with all its texts; what comes is the same."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(250)), pa.array([f"<div>page {k}</div>" for k in range(250)])], ["id", "_html"])
    got = list(page_tree.read_batches(iter([batch]), ["id", "posting"]))
    assert max(b.num_rows for b in got) <= page_tree.PAGES
    assert [(r["id"], r["posting"]["longest"]) for b in got for r in b.to_pylist()] == [(k, f"page {k}") for k in range(250)]
