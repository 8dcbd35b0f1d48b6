"""Session settings that the operators rely on, readers for the tables of a folder, and tables written in between."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cache
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = str(Path(__file__).resolve().parent.parent)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@cache
def _send(application: str) -> None:
    """Send this package, as a zip file, to the executors, which need not see the driver's folders; once an application."""
    target = os.path.join(tempfile.mkdtemp(prefix="larkspur-code-"), "larkspur.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted(Path(REPO, "larkspur").rglob("*.py")):
            archive.write(path, path.relative_to(REPO))
    atexit.register(shutil.rmtree, os.path.dirname(target), ignore_errors=True)
    SparkContext.getOrCreate().addPyFile(target)


def _on_one_machine(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session to UTC and make this package importable in the Python workers: by path on one machine, as a file that Spark sends elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    sc = spark.sparkContext
    if not _on_one_machine(spark):
        _send(sc.applicationId)
        return spark
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([REPO, *paths])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder. Zone-less timestamps become TIMESTAMP once, here."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def unused(name: str, columns: Iterable[str]) -> str:
    """name, or name with so many underscores that none of the columns is called that, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row, however often what follows uses them: a generator of one row stands between, which the optimiser neither merges nor filters through."""
    parts = F.struct(*(c.alias(name) for name, c in columns.items()))
    kept = [c for c in df.columns if c not in columns]
    return df.select(*(F.col(f"`{c}`") for c in kept), F.explode(F.array(parts)).alias("_once")).select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"_once.`{name}`") for name in columns))


@cache
def _own_folder(application: str) -> str:
    folder = tempfile.mkdtemp(prefix="larkspur-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables in between, which all executors can reach: spark.checkpoint.dir. Only on one machine may it be unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _on_one_machine(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder(spark.sparkContext.applicationId)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark can reach it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet to path and go on from the files; the shuffle files of the write go as soon as it ends."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def saved(df: DataFrame) -> DataFrame:
    """Write df as a table below the shared folder and go on from it, which cuts its lineage. It belongs to the application, which `clear` ends."""
    path = f"{_tables(df.sparkSession)}/{uuid.uuid4().hex}"
    for paths in _OWNED:
        paths.append(path)
    return written(df, path)


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables/{spark.sparkContext.applicationId}"


def temporary(spark: SparkSession, name: str) -> str:
    """A new path among the application's tables, which goes with them."""
    return f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"


#: Paths of tables saved within each `owned` block that is open.
_OWNED: list[list[str]] = []


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """The tables that are saved within the block go when it ends; results must be written or collected by then. For one thread of a driver."""
    paths: list[str] = []
    _OWNED.append(paths)
    try:
        yield
    finally:
        _OWNED.remove(paths)
        for path in paths:
            delete(spark, path)


def clear(spark: SparkSession) -> None:
    """Delete the tables that this application's results still read; to be called once these are written or collected."""
    delete(spark, _tables(spark))


class Scratch:
    """Tables below the shared folder that are deleted together, when a with block ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, f"{_tables(spark)}/{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        return written(df, f"{self.folder}/{self.count}")

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        delete(self.spark, self.folder)
