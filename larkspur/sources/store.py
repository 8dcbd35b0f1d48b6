"""Tables that are kept between runs: versions below a folder, each told by a manifest that is published last.

A version's rows are the Parquet folders that its manifest lists. Writing makes a new folder and then publishes the next
manifest by creating a file that must not exist yet: a write that fails before that leaves the version before it as
the latest one, and of two writers that began from the same version the second one is refused. An append
lists the folders before it and its own, so nothing is rewritten; `compact` makes one folder of many. Manifests also carry the
largest id given out so far, which therefore is never given twice, and marks by name: batches of a stream, versions of rules.

A manifest that was cut short counts as not published. Folders that no manifest lists, and versions beyond the last few, are removed by `clean`.
An empty table is a version like any other; a store without versions has no rows to read and says so.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from larkspur.functions.rows import platform_label
from larkspur.functions.urls import dedupe_key
from larkspur.operators import merge
from larkspur.operators.order import numbered
from larkspur.session import Scratch, delete


class Conflict(RuntimeError):
    """Another writer has published the version that this one was to be."""


@dataclass
class Version:
    number: int
    parts: list[str]
    schema: dict
    last_id: int = 0
    marks: dict[str, int] = field(default_factory=dict)


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, name: str) -> list[str]:
        fs = self._files()
        return sorted(s.getPath().getName() for s in fs.listStatus(self._path(name))) if fs.exists(self._path(name)) else []

    def _manifest(self, name: str) -> Version | None:
        fs, path = self._files(), self._path("versions", name)
        file = fs.open(path)
        try:
            raw = bytes(file.readNBytes(int(fs.getFileStatus(path).getLen())))
        finally:
            file.close()
        try:
            return Version(**json.loads(raw))
        except ValueError:
            return None

    def latest(self) -> Version | None:
        """The last version that was published."""
        found = (self._manifest(name) for name in reversed(self._listed("versions")))
        return next((v for v in found if v is not None), None)

    def read(self, version: Version | None = None) -> DataFrame:
        """The rows of a version, the latest unless one is given."""
        version = version or self.latest()
        if version is None:
            raise LookupError(f"{self.folder} holds no version yet")
        schema = StructType.fromJson(version.schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/data/{p}" for p in version.parts)) if version.parts else self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame, *, base: Version | None = None, append: bool = False, last_id: int | None = None, marks: dict[str, int] | None = None) -> Version:
        """Publish rows as the version after base (the one they were made from; the latest unless given), in place of its rows or behind them."""
        base = base or self.latest()
        part = uuid.uuid4().hex
        rows.write.option("compression", "zstd").parquet(f"{self.folder}/data/{part}")
        before = base or Version(0, [], {})
        return self._publish(Version(self._next(before), [*(before.parts if append else []), part], rows.schema.jsonValue(), before.last_id if last_id is None else last_id, before.marks | (marks or {})))

    def mark(self, base: Version, **marks: int) -> Version:
        """Publish the rows of base once more, with marks."""
        return self._publish(Version(self._next(base), base.parts, base.schema, base.last_id, base.marks | marks))

    def _next(self, base: Version) -> int:
        """The number after base, or after manifests behind it that were cut short."""
        number = base.number + 1
        for name in self._listed("versions"):
            if int(name) >= number and self._manifest(name) is None:
                number = int(name) + 1
        return number

    def _publish(self, version: Version) -> Version:
        path = self._path("versions", f"{version.number:012d}")
        try:
            out = self._files().create(path, False)
        except Exception as error:
            if "exist" not in str(error).lower():
                raise
            raise Conflict(f"{self.folder}: version {version.number} was published by another writer") from error
        out.write(bytearray(json.dumps(asdict(version)).encode()))
        out.close()
        return version

    def compact(self) -> Version:
        """The latest version in one folder."""
        base = self.latest()
        return self.write(self.read(base), base=base)

    def clean(self, keep: int = 2) -> None:
        """Remove all but the last versions, and folders that none of those lists."""
        names = self._listed("versions")
        kept = [v for v in (self._manifest(n) for n in names[-keep:]) if v is not None]
        listed = {p for v in kept for p in v.parts}
        for name in names[:-keep]:
            delete(self.spark, f"{self.folder}/versions/{name}")
        for part in self._listed("data"):
            if part not in listed:
                delete(self.spark, f"{self.folder}/data/{part}")


def with_ids(scratch: Scratch, rows: DataFrame, after: int, *order: Column, id: str = "id") -> DataFrame:
    """rows whose id is null get the next ones after a number, in an order; others keep theirs. Rows are numbered by ranges."""
    fresh = numbered(rows.where(F.col(id).isNull()), *order, out="_place", scratch=scratch)
    given = fresh.withColumn(id, (F.col("_place") + F.lit(after)).cast(rows.schema[id].dataType)).drop("_place")
    return rows.where(F.col(id).isNotNull()).unionByName(given.select(rows.columns))


def upsert(store: Store, new: DataFrame, *, id: str = "id", pos: str = "pos", **options) -> Version:
    """Publish the store's jobs after the rows of new were written one by one (`merge.upsert_jobs`); inserted ones get ids in the order of their first rows.

    An empty new publishes the same rows again. Repeated rows of new are written again, to no further effect.
    """
    base = store.latest()
    with Scratch(store.spark) as scratch:
        after = scratch.save(merge.upsert_jobs(store.read(base), new, id=id, pos=pos, first="_first", **options))
        rows = with_ids(scratch, after, base.last_id, F.col("_first"), id=id).drop("_first")
        return store.write(rows, base=base, last_id=base.last_id + after.where(F.col(id).isNull()).count())


#: The rule by which keys are made; a store whose mark is lower is keyed anew.
KEY_RULE = 2


def migrate(store: Store, *, rule: int = KEY_RULE, key_of: Callable[[Column], Column] = dedupe_key, key: str = "dedupe_key", url: str = "url", platform: str = "ats_platform") -> Version:
    """Key the store's jobs anew by their addresses, write platforms' own labels, and merge rows that now share a key; nothing if the store's rule is the present one.

    All rows take their new keys before any are merged, so a new key never meets an old one, and a second run would change nothing. Rows without an
    address keep their key, as there is nothing to make one of.
    """
    base = store.latest()
    if base.marks.get("key_rule", 0) >= rule:
        return base
    rows = store.read(base)
    keyed = rows.withColumn(key, F.when(F.col(url).isNull(), F.col(key)).otherwise(key_of(F.col(url)))).withColumn(platform, platform_label(F.col(platform)))
    with Scratch(store.spark) as scratch:  # keys are made once, not once for each side of the merge
        return store.write(merge.merge_collisions(scratch.save(keyed), key), base=base, marks={"key_rule": rule})
