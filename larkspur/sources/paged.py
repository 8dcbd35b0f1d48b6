"""A listing that comes in pages, as a source that `spark.read.format("paged_listing")` reads.

Captured pages lie below a folder as `<target>/<offset>.json`, offsets being 0, 20, 40 and so on, in any store that pyarrow's file systems
reach by address. A partition is one offset of some targets, so pages are read by as many tasks as there are pages to read, and none reads
more than the targets of its share. The first page tells how many postings there are, later pages don't; so each task takes the total from
the first page and reads its own only if it begins below that. A total of 0, or none, ends nothing. At most ten pages of a target are read.

Rows are target_id, page (from 0) and payload, which `payloads.workday` takes; that also ends a target at its first empty page. A page that was
not captured gives no row; one that is no JSON is given as it is, with no total. Folders that aren't numbers are no targets; an empty folder gives no rows.

Options: path; targets_per_partition (of each offset; 100 unless given); page_size; max_pages.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import opened
from .payloads import MAX_PAGES, PAGE_SIZE

_SCHEMA = pa.schema([("target_id", pa.int64()), ("page", pa.int32()), ("payload", pa.string())])


def _text(files: fs.FileSystem, path: str) -> str | None:
    try:
        with files.open_input_stream(path) as page:
            return page.read().decode()
    except FileNotFoundError:
        return None


def total_of(first: str | None) -> int:
    """How many postings a first page tells of."""
    try:
        told = json.loads(first or "{}").get("total")
    except (ValueError, AttributeError):
        return 0
    return told if isinstance(told, int) and told > 0 else 0


@dataclass
class Page(InputPartition):
    offset: int
    targets: list[int]


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.size, self.most, self.share = (int(options.get(k, d)) for k, d in (("page_size", PAGE_SIZE), ("max_pages", MAX_PAGES), ("targets_per_partition", 100)))

    def partitions(self) -> list[Page]:
        files, root = opened(self.path)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        targets = sorted(int(x.base_name) for x in found if x.type == fs.FileType.Directory and x.base_name.isdigit())
        shares = [targets[k : k + self.share] for k in range(0, len(targets), self.share)]
        return [Page(k * self.size, share) for share in shares for k in range(self.most)] or [Page(0, [])]

    def read(self, partition: Page) -> Iterator[pa.RecordBatch]:
        files, root = opened(self.path)
        for target in partition.targets:
            at = partition.offset
            first = _text(files, f"{root}/{target}/0.json") if at else None
            if at and (total := total_of(first)) and at >= total:
                continue
            payload = _text(files, f"{root}/{target}/{at}.json")
            if payload is not None:
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([at // self.size], pa.int32()), pa.array([payload])], schema=_SCHEMA)


class PagedListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return "target_id long, page int, payload string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """The pages below a folder; the source is registered with the session."""
    spark.dataSource.register(PagedListing)
    return spark.read.format("paged_listing").options(path=path, **options).load()


def capture(pages: DataFrame, path: str) -> None:
    """Write pages (target_id, offset, payload) as a folder that the source reads; each task writes its own pages, and one that is tried again writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(path)
        written = 0
        for batch in batches:
            for target, offset, payload in zip(*(batch.column(c).to_pylist() for c in ("target_id", "offset", "payload")), strict=True):
                files.create_dir(f"{root}/{target}", recursive=True)
                with files.open_output_stream(f"{root}/{target}/{offset}.json") as page:
                    page.write(payload.encode())
                written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written])], ["n"])

    pages.select("target_id", "offset", "payload").mapInArrow(run, "n long").count()
