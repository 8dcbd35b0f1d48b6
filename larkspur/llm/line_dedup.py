"""Site-relative line frequency, in DataFrame functions only.

A line's ratio on a host is the number of the host's pages that contain it by the number of the host's
pages. Lines beyond the boilerplate ratio are dropped from that host's pages. Lines are compared
without white space at their ends; blank lines are never dropped. Hosts of all sizes are judged. A line
that stands on one page only (of `min_repeats` - 1 pages, 1 by default) is no repetition: on a host of
few pages its share alone would drop whatever is there. A line at just the ratio stays.

Counts are partial sums per (host, line) of what each page has once, so that a host with a third of
all pages is no hot key; joins on (host, line) are of the splittable kind. Only hashes (128 bits of a
line) and places are shuffled for the counts; texts move once, to meet the places to drop.

Null hosts form one host. Null texts have no lines and stay null. Rows are told apart by the id: rows
that repeat an id count as often as they occur and lose the same lines. Rows with a null id are
counted but not changed. An empty table gives an empty result. Texts and lines may be of any length; only
digests of lines are compared. Other columns stay as they are, whatever their names, but one that has
the name of the report is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.session import saved, unused

RATIO = 0.1
MIN_REPEATS = 2
BLANKS = " \t\n\x0b\f\r"
#: The digest of a blank line.
BLANK = hashlib.md5(b"").hexdigest()


def page_lines(text: Column) -> Column:
    return F.split(text, "\n")


def _digest(line: Column) -> Column:
    """The line's 128-bit digest in hex."""
    return F.md5(F.btrim(line, F.lit(BLANKS)).cast("binary"))


def lines_of(pages: DataFrame, page_id: str, host: str, text: str) -> DataFrame:
    """id, host and key of each different line of a page that isn't blank."""
    # Distinct as strings, of which Spark makes a hash set; binary values it compares each with each.
    keys = F.array_distinct(F.filter(F.transform(page_lines(F.col(text).cast("string")), _digest), lambda k: k != BLANK))
    return pages.select(F.col(page_id).alias("id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.explode(keys).alias("key")).withColumn("key", F.unhex("key"))


def boilerplate(lines: DataFrame, pages: DataFrame, host: str, ratio: float, min_repeats: int) -> DataFrame:
    """host, key, n_pages, host_pages and ratio of the lines that are dropped."""
    counts = lines.groupBy("host", "key").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_repeats)
    totals = pages.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")).agg(F.count("*").alias("host_pages"))
    return counts.join(totals, "host").withColumn("ratio", F.col("n_pages") / F.col("host_pages")).where(F.col("ratio") > ratio)


def dropped(pages: DataFrame, *, page_id: str = "page_id", host: str = "host", text: str = "text", ratio: float = RATIO, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """id and the keys of its lines that are dropped; pages without such lines are not listed."""
    lines = saved(lines_of(pages, page_id, host, text))
    common = boilerplate(lines, pages, host, ratio, min_repeats).select("host", "key")
    hits = lines.where(F.col("id").isNotNull()).join(common, ["host", "key"])
    return hits.groupBy("id").agg(F.collect_set("key").alias("keys"))


def clean(pages: DataFrame, *, page_id: str = "page_id", host: str = "host", text: str = "text", report: str | None = None, emptied: bool = True, **limits) -> DataFrame:
    """pages without boilerplate lines. report: the name of a column for the number of lines dropped.

    emptied: whether a page of nothing but boilerplate loses all its lines; else that page is left as it is.
    """
    own_id, keys, lines, kept, n = (unused(x, [*pages.columns, report or ""]) for x in ("own_id", "keys", "lines", "kept_lines", "n_gone"))
    gone = dropped(pages, page_id=page_id, host=host, text=text, **limits).select(F.col("id").alias(own_id), F.col("keys").alias(keys))
    split = F.transform(page_lines(F.col(text)), lambda x: F.struct(x.alias("line"), F.unhex(_digest(x)).alias("key")))
    blank = F.unhex(F.lit(BLANK))
    out = pages.join(gone, F.col(page_id) == F.col(own_id), "left").withColumn(lines, F.when(F.col(keys).isNotNull(), split))
    out = out.withColumn(kept, F.filter(lines, lambda x: (x["key"] == blank) | ~F.array_contains(F.col(keys), x["key"]))).withColumn(n, F.size(lines) - F.size(kept))
    if not emptied:
        filled = F.size(F.filter(lines, lambda x: x["key"] != blank))
        out = out.withColumn(n, F.when(F.col(n) < filled, F.col(n)))
    joined = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    out = out.withColumn(text, F.when(F.col(n).isNotNull(), joined).otherwise(F.col(text)))
    if report:
        out = out.withColumn(report, F.coalesce(n, F.lit(0)).cast("long"))
    return out.drop(own_id, keys, lines, kept, n)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
