"""Derived WARC records: each response gets a metadata record and a plain-text conversion record.

Both refer to the response by its identifier and name each other as concurrent; the metadata record
carries the response's HTTP headers and digests on. All of it is DataFrame functions, row by row, with
no shuffle. Records can be written as WARC files and read again.

Responses have record_id, target_uri, date and block, all strings; the block is an HTTP message, whose
status line and headers are parsed, and whose body is the payload. A block that is no HTTP message is
payload as a whole and has no headers. A null block is empty; a null date is that of the whole capture, if
one is given; null addresses leave their field out. Records without a date are not written, as no reader takes them. A null record_id leaves Refers-To out. Rows that repeat give equal records, an empty table
gives none, and texts may be of any length: all patterns run through a page once. There are no ties.
Other columns stay beside the records; those whose names the records use get underscores behind them.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import unescape
from larkspur.session import unused
from larkspur.sources.files import opened

CRLF = "\r\n"
COLUMNS = ["record_id", "type", "refers_to", "concurrent_to", "target_uri", "date", "content_type", "source_status", "source_headers", "payload_digest", "block_digest", "content_length", "block"]
#: The fields of a record's head, in order.
FIELDS = {
    "type": "WARC-Type", "record_id": "WARC-Record-ID", "refers_to": "WARC-Refers-To", "concurrent_to": "WARC-Concurrent-To", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type",
    "source_status": "WARC-Source-HTTP-Status", "source_headers": "WARC-Source-HTTP-Headers", "payload_digest": "WARC-Source-Payload-Digest", "block_digest": "WARC-Block-Digest", "content_length": "Content-Length",
}
#: What a response is made of.
RESPONSE = ["record_id", "target_uri", "date", "block"]
#: Elements whose ends break a line, and those whose content is no text; where these aren't closed, the rest of the page is none.
BREAKS = "(?i)</?(p|div|br|li|ul|ol|tr|table|h[1-6]|article|section|nav|header|footer|title|body|head|html|pre|blockquote)(\\s[^<>]*)?/?>"
_SILENT = ["script[^<>]*>.*?(?:</script>|\\z)", "style[^<>]*>.*?(?:</style>|\\z)", "!--.*?(?:-->|\\z)"]
SILENT = f"(?is){'|'.join(f'<{x}' for x in _SILENT)}"
#: The same, with what all start with in front: else Java tries each at every character.
SILENT_AT = f"(?is)<(?:{'|'.join(_SILENT)})"
#: Runs of blanks, but for those that are one space already.
UNEVEN = "[ \\t\\f\\r\u00a0](?:[ \\t\\f\\r\u00a0]+|(?<! ))"


def uuid_of(seed: Column) -> Column:
    """A name-based identifier in the form of WARC record ids."""
    return F.regexp_replace(F.md5(F.encode(seed, "utf-8")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def plain_text(html: Column) -> Column:
    """A page's text, a line for each block; character references are decoded, white space is collapsed, no-break spaces are plain ones."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, SILENT_AT, ""), BREAKS, "\n"), "<[^<>]*>", "")
    lines = F.transform(F.split(unescape(text), "\n"), lambda line: F.trim(F.regexp_replace(line, UNEVEN, " ")))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(F.encode(block, "utf-8")))


def _kept(df: DataFrame, names: list[str]) -> DataFrame:
    """df with underscores behind the columns that have one of the names."""
    taken = [*names, *df.columns]
    for c in df.columns:
        if c.lower() in {x.lower() for x in names}:
            df = df.withColumnRenamed(c, new := unused(c, taken))
            taken.append(new)
    return df


def responses(pages: DataFrame, *, url: str = "url", html: str = "html", date: str | None = None, status: str = "HTTP/1.1 200 OK", headers: tuple[str, ...] = ("Content-Type: text/html; charset=utf-8",)) -> DataFrame:
    """Response records of a table of pages, beside the pages' own columns. date: the name of a column with the time of capture, if there is one.

    The pages' tables hold bodies only; status line, type and length are put before them as a server would.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    made = {
        "record_id": uuid_of(F.concat_ws("|", F.lit("response"), F.coalesce(F.col(url), F.lit("")), F.sha1(F.encode(body, "utf-8")))),
        "target_uri": F.col(url),
        "date": F.col(date).cast("string") if date else F.lit(None).cast("string"),
        "block": F.when(F.col(html).isNotNull(), F.concat(F.lit(CRLF.join([status, *headers, "Content-Length: "])), F.octet_length(body).cast("string"), F.lit(CRLF * 2), body)),
    }
    out = pages.withColumns({f"{unused('made', pages.columns)}{k}": c for k, c in made.items()})
    names = out.columns[len(pages.columns) :]
    return _kept(out, RESPONSE).withColumnsRenamed(dict(zip(names, made, strict=True)))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))


def derive(source: DataFrame, captured: str | None = None) -> DataFrame:
    """Two records for each response. captured: the date of those that have none, as 2024-01-31T00:00:00Z."""
    others = [c for c in source.columns if c not in RESPONSE]
    source = _kept(source.select(*(F.col(f"`{c}`") for c in others), *(F.col(c).alias(f"{unused('of', others)}{c}") for c in RESPONSE)), COLUMNS)
    others, names = source.columns[: len(others)], source.columns[len(others) :]
    given, target, date, message = (F.col(c) for c in names)
    date = F.coalesce(date, F.lit(captured))
    made = unused("made", source.columns)
    # Projections of their own, so that each text, digest and identifier is made once.
    parts = F.split(F.coalesce(message, F.lit("")), CRLF * 2, 2)
    source = source.withColumn(made, F.when(message.startswith("HTTP/"), F.struct(parts[0].alias("head"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("payload"))).otherwise(F.struct(F.lit(None).cast("string").alias("head"), F.coalesce(message, F.lit("")).alias("payload"))))
    payload, head = F.col(f"{made}.payload"), F.col(f"{made}.head")
    source = source.withColumn(made, F.struct(
        plain_text(payload).alias("text"), digest(payload).alias("payload_digest"), F.octet_length(payload).cast("string").alias("length"),
        F.regexp_extract(head, "^HTTP/[0-9.]+ +([0-9]{3})", 1).alias("status"), F.regexp_replace(F.nullif(F.regexp_replace(head, "^[^\r\n]*(\r?\n)?", ""), F.lit("")), "(\r?\n[ \t]*)+", "; ").alias("headers"),
    ))
    field = lambda name: F.col(f"{made}.{name}")
    seed = lambda kind: uuid_of(F.concat_ws("|", F.lit(kind), F.coalesce(given, F.lit("")), F.coalesce(target, F.lit("")), field("payload_digest")))
    source = source.withColumn(made, F.struct(*(field(x).alias(x) for x in ("text", "payload_digest", "length", "status", "headers")), *(seed(x).alias(x) for x in ("metadata", "conversion"))))
    lines = F.concat(
        _field("source-record", given), _field("source-payload-digest", field("payload_digest")), _field("source-length", field("length")),
        _field("source-status", field("status")), _field("source-headers", field("headers")), _field("conversion", field("conversion")),
    )
    record = lambda kind, other, mime, block: F.struct(
        field(kind).alias("record_id"), F.lit(kind).alias("type"), given.alias("refers_to"), field(other).alias("concurrent_to"), target.alias("target_uri"), date.alias("date"), F.lit(mime).alias("content_type"),
        field("status").alias("source_status"), field("headers").alias("source_headers"), field("payload_digest").alias("payload_digest"), digest(block).alias("block_digest"), F.octet_length(block).cast("long").alias("content_length"), block.alias("block"),
    )
    both = F.array(record("metadata", "conversion", "application/warc-fields", lines), record("conversion", "metadata", "text/plain; charset=utf-8", field("text")))
    keep = [F.col(f"`{c}`") for c in others]
    return source.select(*keep, F.explode(both).alias(made)).select(*keep, f"{made}.*")


def serialised(records: DataFrame) -> DataFrame:
    """One string column, the records in WARC/1.1 form without the two line ends that follow each. A record without a date is refused."""
    dated = F.coalesce(F.col("date"), F.raise_error(F.lit("a WARC record must have a date")).cast("string"))
    head = F.concat(F.lit(f"WARC/1.1{CRLF}"), *(_field(name, dated if c == "date" else F.col(c).cast("string")) for c, name in FIELDS.items()), F.lit(CRLF))
    return records.select(F.concat(head, F.col("block")).alias("value"))


def write(records: DataFrame, path: str) -> None:
    """WARC files below path, one for each partition that has records, each record a gzip member of its own, so that readers can seek.

    A task writes beside and renames when it is done; one that is tried again writes the same file. path is one that pyarrow's file systems reach from all executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        files, root = opened(path)
        name, beside, n = f"{root}/part-{task.partitionId():06d}.warc.gz", f"{root}/.part-{task.partitionId():06d}-{task.taskAttemptId()}", 0
        out = None
        for batch in batches:
            for value in batch.column("value"):
                if out is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(beside)
                out.write(gzip.compress(value.as_py().encode() + f"{CRLF}{CRLF}".encode(), 6, mtime=0))
                n += 1
        if out is not None:
            out.close()
            files.move(beside, name)
        yield pa.RecordBatch.from_arrays([pa.array([n])], ["n"])

    serialised(records).mapInArrow(run, "n long").agg(F.sum("n")).first()


_LINE = re.compile(r"^([A-Za-z-]+):[ \t]*(.*?)\r?$", re.M)


def members(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Heads (by field, the first of several) and blocks of a WARC stream, walked by the lengths that heads tell. One record is held at a time."""
    held = b""
    while True:
        while (cut := held.find(b"\r\n\r\n")) < 0:
            more = stream.read(1 << 16)
            if not more:
                return
            held += more
        head = held[:cut].decode("utf-8", "replace").lstrip("\r\n")
        fields = {}
        for name, value in _LINE.findall(head):
            fields.setdefault(name.lower(), value)
        size = int(fields.get("content-length", 0))
        held = held[cut + 4 :]
        while len(held) < size + 4 and (more := stream.read(max(1 << 16, size + 4 - len(held)))):
            held += more
        yield fields, held[:size]
        held = held[size:].lstrip(b"\r\n")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files (.warc or .warc.gz) below path whose blocks are text; bytes that are no UTF-8 are replaced. A file is read by one task, a record at a time."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").option("recursiveFileLookup", True).load(path).select("path")
    kinds = ", ".join(f"{c} {'long' if c == 'content_length' else 'string'}" for c in COLUMNS)
    schema = pa.schema([(c, pa.int64() if c == "content_length" else pa.string()) for c in COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                files, own = opened(name)
                with files.open_input_stream(own, compression=None) as raw:
                    rows, held = [], 0
                    for fields, block in members(gzip.GzipFile(fileobj=raw) if own.endswith(".gz") else raw):
                        row = {c: fields.get(field.lower()) for c, field in FIELDS.items()}
                        rows.append(row | {"content_length": len(block), "block": block.decode("utf-8", "replace")})
                        held += len(block)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return listed.mapInArrow(run, kinds)
