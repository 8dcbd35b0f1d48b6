"""Queries over captured payloads of boards, made of documents, fifty to a board."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.session import prepare, table
from larkspur.sources import payloads

from .queries import _values, query

_SHOWN = "pos, url, title, description, posted_at, location"
_BOARD = "target_id long, payload string"


def boards(spark, d, job, of="jobs"):
    """A payload for each fifty documents: an array of what job makes of each document, in order of ids, under a name if there is one."""
    docs = table(prepare(spark), d, "documents").select(F.floor(_i() / 50).alias("target_id"), F.struct("doc_id", job.alias("j")).alias("x"))
    array = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["j"])
    return docs.groupBy("target_id").agg((F.to_json(F.struct(array.alias("jobs"))) if of == "jobs" else F.to_json(array)).alias("payload")).unionByName(_values(spark, _BOARD, [(-1, "not json")]))


_i = lambda: F.col("doc_id")
_ID = lambda prefix: F.concat(F.lit(prefix), _i().cast("string"))
_DAY = lambda n: F.date_format(F.date_sub(F.lit("2024-01-31"), (_i() % n).cast("int")), "yyyy-MM-dd")
_SQL_DAY = lambda n: f"CAST(DATE '2024-01-31' - CAST(doc_id % {n} AS INTEGER) AS VARCHAR)"
_TARGET = "doc_id // 50"


@query(f"""SELECT {_TARGET} AS target_id, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY published DESC, doc_id) - 1 AS pos, 'u' || doc_id AS url, 'T' || doc_id AS title, 'Job & ' || doc_id || ' <b> x' AS description,
 CASE WHEN published <> '' THEN substr(published, 1, 10) WHEN doc_id % 5 = 0 THEN '2024-05-01' END AS posted_at, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END AS location FROM (SELECT *, CASE WHEN doc_id % 4 > 0 THEN {_SQL_DAY(30)} || 'T00:00:00Z' ELSE '' END AS published FROM documents)""")
def s9_greenhouse(spark, d):
    job = F.struct(
        _ID("u").alias("absolute_url"), _ID("T").alias("title"), F.concat(F.lit("<p>Job &amp; "), _i().cast("string"), F.lit(" &lt;b&gt;</p>  x")).alias("content"), F.when(_i() % 4 > 0, F.concat(_DAY(30), F.lit("T00:00:00Z"))).alias("first_published"),
        F.when(_i() % 5 == 0, "2024-05-01T1").alias("updated_at"), F.when(_i() % 3 == 0, F.struct(F.col("lang").alias("name"))).alias("location"),
    )
    return payloads.greenhouse(boards(spark, d, job, "jobs")).select("target_id", *_SHOWN.split(", "))


@query(f"""SELECT {_TARGET} AS target_id, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY published DESC, doc_id) - 1 AS pos, 'u' || doc_id AS url, 'T' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'plain ' || doc_id ELSE 'rich ' || doc_id END AS description,
 nullif(substr(published, 1, 10), '') AS posted_at, CASE WHEN doc_id % 3 = 0 THEN lang || ', Dublin' ELSE 'Dublin' END AS location FROM (SELECT *, CASE WHEN doc_id % 4 > 0 THEN {_SQL_DAY(30)} || 'T1' ELSE '' END AS published FROM documents WHERE doc_id % 7 <> 0)""")
def s10_ashby(spark, d):
    job = F.struct(
        _ID("u").alias("jobUrl"), _ID("T").alias("title"), F.when(_i() % 2 == 0, _ID("plain ")).otherwise("").alias("descriptionPlain"), F.concat(F.lit("<b>rich"), F.lit("</b>"), _i().cast("string")).alias("descriptionHtml"),
        F.when(_i() % 4 > 0, F.concat(_DAY(30), F.lit("T1"))).alias("publishedAt"), F.when(_i() % 7 == 0, False).when(_i() % 7 == 1, True).alias("isListed"), F.when(_i() % 3 == 0, F.col("lang")).alias("location"), F.array(F.lit(""), F.lit("Dublin")).alias("secondaryLocations"),
    )
    return payloads.ashby(boards(spark, d, job, "jobs")).select("target_id", *_SHOWN.split(", "))


@query(f"""SELECT {_TARGET} AS target_id, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY coalesce(ms, 0) DESC, doc_id) - 1 AS pos, 'u' || doc_id AS url, 'T' || doc_id AS title, 'x' || doc_id || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || 'y' ELSE '' END AS description,
 CASE WHEN ms IS NOT NULL THEN {_SQL_DAY(30)} END AS posted_at, CASE doc_id % 3 WHEN 0 THEN 'Oslo' WHEN 1 THEN lang ELSE '' END AS location FROM (SELECT *, CASE WHEN doc_id % 4 > 0 THEN epoch_ms(CAST(DATE '2024-01-31' - CAST(doc_id % 30 AS INTEGER) AS TIMESTAMP)) END AS ms FROM documents)""")
def s11_lever(spark, d):
    job = F.struct(
        _ID("u").alias("hostedUrl"), _ID("T").alias("text"), _ID("x").alias("descriptionPlain"), F.when(_i() % 2 == 0, "y ").alias("descriptionBodyPlain"), F.when(_i() % 4 > 0, F.unix_millis(_DAY(30).cast("timestamp"))).alias("createdAt"),
        F.when(_i() % 3 == 0, F.struct(F.lit("Oslo").alias("location"))).alias("categories"), F.when(_i() % 3 == 1, F.col("lang")).alias("country"),
    )
    return payloads.lever(boards(spark, d, job, "array")).select("target_id", *_SHOWN.split(", "))


