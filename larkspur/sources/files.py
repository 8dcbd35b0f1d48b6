"""Files kept by people: a history in CSV, a corpus of notes, lists of codes, names and adjustments."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from itertools import islice
from stat import S_ISDIR
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.rows import platform_label
from larkspur.functions.text import front_matter, strip
from larkspur.session import Scratch, delete, saved

from .store import Store


def flag(value: Column) -> Column:
    return F.coalesce(F.upper(F.trim(value)) == "TRUE", F.lit(False))


def history(spark: SparkSession, path: str) -> DataFrame:
    """A CSV history with quoted cells and a header."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def import_history(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows that were applied to, as postings with their outcome flags; those whose address is known, or came before, are left out."""
    text = lambda c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    own = rows.where(flag(F.col("`Applied T/F`"))).select(
        F.concat(F.lit("csv-import://"), text("Position (branch)")).alias("url"), text("Company").alias("company"), text("Position (branch)").alias("title"), platform_label(text("Platform Name")).alias("ats_platform"),
        F.lit("applied").alias("status"), *(flag(F.col(f"`{c}`")).cast("int").alias(name) for c, name in (("Referral", "referral"), ("Callback T/F", "callback"), ("Ghosted", "ghosted"), ("Offer", "offer"))), text("Notes").alias("notes"),
    )
    first = F.row_number().over(Window.partitionBy("url").orderBy("company", "notes"))
    return own.withColumn("_n", first).where(F.col("_n") == 1).drop("_n").join(known.select("url").distinct(), "url", "left_anti")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Notes below a folder, one row a file: path, modified, meta and body."""
    own = read_files(listing(spark, folder)).select("path", "modified", front_matter(F.col("text")).alias("doc"))
    return own.select("path", "modified", "doc.meta", "doc.body")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, and the path in it; what names none is local. file:///a%20b is an address, file:/a b a path as Hadoop writes it."""
    kind, _, rest = path.partition(":")
    if not rest or kind == "file":
        return fs.LocalFileSystem(), "/" + (unquote(rest) if kind == "file" and rest.startswith("//") else rest if kind == "file" else unquote(path)).lstrip("/")
    return fs.FileSystem.from_uri(path)


def _within(path: str) -> Iterator[tuple[str, int, int, bool]]:
    """What lies directly in a folder, or a file itself: path, time of modification in milliseconds, length, and whether it is a folder. Names that Spark passes over are left out. A local folder is never held whole."""
    files, own = opened(path)
    seen = lambda name: not name.startswith(".") and not (name.startswith("_") and "=" not in name)
    if isinstance(files, fs.LocalFileSystem) and os.path.isdir(own):
        with os.scandir(own) as found:
            for entry in found:
                try:
                    status = entry.stat()
                except FileNotFoundError:
                    continue
                if seen(entry.name):
                    yield f"{path.rstrip('/')}/{entry.name}", status.st_mtime_ns // 1_000_000, status.st_size, S_ISDIR(status.st_mode)
        return
    itself = files.get_file_info(own)
    if itself.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    alone = itself.type == fs.FileType.File
    for entry in [itself] if alone else files.get_file_info(fs.FileSelector(own)):
        if alone or seen(entry.base_name):
            yield path if alone else f"{path.rstrip('/')}/{entry.base_name}", (entry.mtime_ns or 0) // 1_000_000, entry.size or 0, entry.type == fs.FileType.Directory


def _levels(spark: SparkSession, folder: str, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All files and folders below a folder, told level by level: the folders of a level are shared out to tasks, so the driver holds no list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (x for batch in batches for path in batch.column("path").to_pylist() for x in _within(path))
        while some := list(islice(found, 10_000)):
            path, modified, length, is_folder = zip(*some, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(modified, pa.int64()), pa.array(length, pa.int64()), pa.array(is_folder)], ["path", "modified", "length", "is_folder"])

    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString()
    folders, out = spark.createDataFrame([(root,)], "path string"), None
    while True:
        level = save(folders.mapInArrow(run, "path string, modified long, length long, is_folder boolean").select("path", F.timestamp_millis("modified").alias("modified"), "length", "is_folder"))
        out = level if out is None else out.union(level)
        folders = _shared_out(level.where("is_folder").select("path"))
        if level.where("is_folder").isEmpty():
            return out


def _shared_out(rows: DataFrame) -> DataFrame:
    """rows dealt out evenly, as what is done for each takes much longer than their bytes tell."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def listing(spark: SparkSession, folder: str, endings: tuple[str, ...] = (".md", ".txt"), scratch: Scratch | None = None) -> DataFrame:
    """path, modified and length of the files below a folder whose names end so (all files, for no endings), or of a file itself; their contents aren't read. With a scratch, what is written goes with it."""
    found = _levels(spark, folder, scratch.save if scratch else saved).where("NOT is_folder").drop("is_folder")
    return found.where(F.greatest(F.lit(False), *(F.endswith("path", F.lit(e)) for e in endings))) if endings else found


#: Files and bytes that a task reads before it hands them on.
MOST_FILES, MOST_READ = 1_000, 4 << 20


def read_files(listed: DataFrame) -> DataFrame:
    """listed (path, ...) with the text of each file and the SHA-256 of its bytes; those that are gone by now are left out. Each task opens the files of its rows, so only those are read."""
    kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in listed.schema), "text string, sha256 string"])
    names = listed.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, hashes, size = [], [], [], 0
            for k, path in enumerate(batch.column("path").to_pylist()):
                files, own = opened(path)
                try:
                    with files.open_input_stream(own) as file:
                        raw = file.read()
                except FileNotFoundError:
                    continue
                rows.append(k)
                texts.append(raw.decode("utf-8", "replace"))
                hashes.append(hashlib.sha256(raw).hexdigest())
                size += len(raw)
                if len(rows) == MOST_FILES or size > MOST_READ:
                    yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(texts), pa.array(hashes)], [*names, "text", "sha256"])
                    rows, texts, hashes, size = [], [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(texts), pa.array(hashes)], [*names, "text", "sha256"])

    return _shared_out(listed).mapInArrow(run, kinds)


def write_files(rows: DataFrame, folder: str) -> None:
    """Write rows (path, text) as files below a folder; each task writes its own, and one that is tried again writes the same. A null text is an empty file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(folder)
        written, made = 0, set()
        for batch in batches:
            for path, text in zip(batch.column("path"), batch.column("text"), strict=True):
                own = f"{root}/{path.as_py()}"
                if (above := own.rpartition("/")[0]) not in made:
                    files.create_dir(above, recursive=True)
                    made.add(above)
                with files.open_output_stream(own) as file:
                    file.write((text.as_py() or "").encode())
                written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written])], ["n"])

    rows.select("path", "text").mapInArrow(run, "n long").count()


def delete_files(spark: SparkSession, folder: str) -> None:
    """Delete a folder and all below it; each task deletes its share of the files, and only folders are left to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, own = opened(path)
                try:
                    files.delete_file(own)
                except FileNotFoundError:  # a task that is tried again
                    continue
                gone += 1
        yield pa.RecordBatch.from_arrays([pa.array([gone])], ["n"])

    with Scratch(spark) as scratch:
        _shared_out(listing(spark, folder, (), scratch).select("path")).mapInArrow(run, "n long").count()
    delete(spark, folder)


#: Columns of a stored corpus.
STORED = ["path", "modified", "length", "sha256", "meta", "body"]


def changes(stored: DataFrame, present: DataFrame) -> DataFrame:
    """path and change (added, changed, gone) of files whose listing (path, modified, length) differs from what is stored.

    Files that keep time and length count as unchanged and aren't read. Of the others, whose contents are read, those that keep their hash are left out too.
    Repeated paths are one file.
    """
    s = stored.select("path", F.col("modified").alias("_modified"), F.col("length").alias("_length"), F.col("sha256").alias("_sha256")).dropDuplicates(["path"])
    both = present.dropDuplicates(["path"]).withColumn("_here", F.lit(True)).join(s, "path", "full")
    gone = both.where(F.col("_here").isNull()).select("path", F.lit("gone").alias("change"))
    read = read_files(both.where(F.col("_here") & ~(F.col("modified").eqNullSafe(F.col("_modified")) & F.col("length").eqNullSafe(F.col("_length")))).select("path", "modified", "length", "_sha256"))
    kind = F.when(F.col("_sha256").isNull(), "added").when(F.col("_sha256") != F.col("sha256"), "changed").otherwise("touched")
    front = front_matter(F.col("text"))
    found = read.select("path", kind.alias("change"), "modified", "length", "sha256", front["meta"].alias("meta"), front["body"].alias("body"))
    return found.unionByName(gone, allowMissingColumns=True)


def reload(store: Store, folder: str, check: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """Bring a stored corpus up to date with a folder; gives path and change of what differed.

    Contents are read of new and of touched files only, and once; all others are taken from the version before. check may raise on the new corpus, which
    leaves the version before as the latest. Nothing is published where nothing differs, touched times apart.
    """
    spark = store.spark
    base = store.latest()
    empty = "path string, modified timestamp, length long, sha256 string, meta map<string,string>, body string"
    stored = spark.createDataFrame([], empty) if base is None else store.read(base)
    with Scratch(spark) as scratch:
        found = scratch.save(changes(stored, listing(spark, folder, scratch=scratch)))
        told = found.where(F.col("change") != "touched").select("path", "change")
        out = saved(told)
        if found.isEmpty():
            return out
        rows = stored.join(found.select("path"), "path", "left_anti").unionByName(found.where(F.col("change") != "gone").select(STORED))
        if check is not None:
            check(rows)
        store.write(rows.select(STORED), base=base)
        return out


def text_file(spark: SparkSession, path: str) -> DataFrame:
    """A text, or each one below a folder, with when it was modified and the SHA-256 of its bytes."""
    return read_files(listing(spark, path, ())).select("path", "modified", "text", "sha256")


def header(path: Column, meta: Column) -> Column:
    """A document's line of title, type, date, tags and summary; path and folder stand in for the first two."""
    has = lambda k: F.nullif(F.try_element_at(meta, F.lit(k)), F.lit(""))
    title = F.concat(F.lit("title: "), F.coalesce(has("title"), path))
    kind = F.concat(F.lit("type: "), F.coalesce(has("type"), F.substring_index(path, "/", 1)))
    return F.concat_ws(" | ", title, kind, *(F.concat(F.lit(f"{k}: "), has(k)) for k in ("date", "tags", "summary")))


def profile_card(documents: DataFrame, names: tuple[str, ...] = ("profile.md", "profile.txt")) -> DataFrame:
    """One row, the card: header and first twelve lines of the profile document (path, meta, body), or that there is none."""
    head = strip(F.array_join(F.slice(F.split("body", "\\r\\n|[\\n\\r]"), 1, 12), "\n"))
    cards = documents.where(F.col("path").isin(*names)).select("path", F.concat(header(F.col("path"), F.col("meta")), F.lit("\n\n"), head).alias("card"))
    return cards.agg(F.coalesce(F.min_by("card", "path"), F.lit("No profile document published.")).alias("card"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One row that changes with any path or time of modification: a sum over the files, in any order."""
    return files.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("path", "modified").cast("decimal(20,0)")), F.lit(0)).alias("fingerprint"))


def _kept(lines: Column) -> Column:
    return F.filter(F.transform(lines, strip), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))


def listed(text: Column) -> Column:
    """The lines that are neither blank nor comments."""
    return _kept(F.split(text, "\r?\n"))


def codes(lines: DataFrame, line: str = "line") -> DataFrame:
    """code, label, expires, url_auth, revoked and note of lines of the form code | label | options."""
    parts = F.transform(F.split(F.trim(line), "\\|"), strip)
    rows = lines.where(~F.rlike(line, F.lit("^\\s*(#|$)"))).select(parts.alias("p")).where((F.size("p") >= 2) & (F.get("p", 0) != ""))
    rest = F.slice("p", F.lit(3), F.greatest(F.size("p") - 2, F.lit(0)))
    last = lambda key: F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter(rest, lambda x: F.startswith(x, F.lit(f"{key}="))), lambda x: F.substring(x, F.lit(len(key) + 2), F.length(x)))), -1)
    return rows.select(F.get("p", 0).alias("code"), F.get("p", 1).alias("label"), last("expires").alias("expires"), F.array_contains(rest, "url_auth").cast("int").alias("url_auth"), F.array_contains(rest, "revoked").cast("int").alias("revoked"), last("note").alias("note"))


def adjustments(lines: DataFrame, line: str = "line", pos: str = "pos") -> DataFrame:
    """pos, name and points of lines of the form name: points # comment; the last colon splits, and the last line of a name counts."""
    text = F.trim(line)
    rows = lines.where(~F.startswith(text, F.lit("#")) & F.contains(text, F.lit(":"))).select(pos, F.lower(F.trim(F.regexp_extract(text, "^(.*):", 1))).alias("name"), F.expr(f"try_cast(trim(substring_index(substring_index(trim({line}), ':', -1), '#', 1)) AS double)").alias("points"))
    rows = rows.where(F.col("points").isNotNull())
    return rows.groupBy("name").agg(F.min(pos).alias("pos"), F.max_by("points", pos).alias("points")).select("pos", "name", "points")
