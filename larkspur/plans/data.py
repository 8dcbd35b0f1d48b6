"""The driver's tables seen as postings, outcomes, sessions and counters, in Spark and as SQL for the oracle."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import OPEN_NAMES
from larkspur.session import prepare, table

AS_OF = "2024-01-31"


def as_of() -> Column:
    return F.lit(AS_OF).cast("date")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    day = lambda start, n: F.date_sub(F.lit(start).cast("date"), (i % n).cast("int"))
    return table(prepare(spark), sf_dir, "documents").select(
        i.alias("id"),
        F.concat(F.lit("https://jobs.example.com/"), F.col("source"), F.lit("/"), (i % 700).cast("string")).alias("url"),
        F.concat(F.lit("k"), (i % 800).cast("string")).alias("dedupe_key"),
        F.concat(F.lit("Company "), (i % 97).cast("string")).alias("company"),
        F.col("text").alias("title"),
        F.col("text").alias("description"),
        F.col("source").alias("ats_platform"),
        F.col("lang").alias("discovered_by"),
        F.when(i % 10 == 0, "applied").when(i % 10 == 1, "closed").when(i % 10 <= 4, "discovered").otherwise("ranked").alias("status"),
        ((i * 37) % 100 + 1).cast("double").alias("fit_score"),
        F.when(i % 3 != 0, ((i * 53) % 100 + 1).cast("double")).alias("desirability_score"),
        (i % 17 == 0).cast("int").alias("gated"),
        F.when(i % 11 == 0, F.lit(None)).when(i % 13 == 0, "soon").otherwise(day("2024-01-01", 200).cast("string")).alias("posted_at"),
        day("2024-01-20", 60).cast("string").alias("discovered_at"),
        F.when(i % 10 == 0, day("2024-01-25", 20).cast("string")).alias("applied_at"),
    )


JOBS = """jobs AS (SELECT doc_id AS id, 'https://jobs.example.com/' || source || '/' || CAST(doc_id % 700 AS VARCHAR) AS url,
 'k' || CAST(doc_id % 800 AS VARCHAR) AS dedupe_key, 'Company ' || CAST(doc_id % 97 AS VARCHAR) AS company, text AS title, text AS description,
 source AS ats_platform, lang AS discovered_by,
 CASE WHEN doc_id % 10 = 0 THEN 'applied' WHEN doc_id % 10 = 1 THEN 'closed' WHEN doc_id % 10 <= 4 THEN 'discovered' ELSE 'ranked' END AS status,
 CAST((doc_id * 37) % 100 + 1 AS DOUBLE) AS fit_score, CASE WHEN doc_id % 3 <> 0 THEN CAST((doc_id * 53) % 100 + 1 AS DOUBLE) END AS desirability_score,
 CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS gated,
 CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'soon' ELSE CAST(DATE '2024-01-01' - CAST(doc_id % 200 AS INTEGER) AS VARCHAR) END AS posted_at,
 CAST(DATE '2024-01-20' - CAST(doc_id % 60 AS INTEGER) AS VARCHAR) AS discovered_at,
 CASE WHEN doc_id % 10 = 0 THEN CAST(DATE '2024-01-25' - CAST(doc_id % 20 AS INTEGER) AS VARCHAR) END AS applied_at FROM documents)"""


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    flag = lambda c: c.cast("int")
    return table(prepare(spark), sf_dir, "labels").select(
        i.alias("job_id"), flag(i % 7 == 0).alias("referral"), F.col("quality").cast("int").alias("callback"), flag(i % 5 == 0).alias("ghosted"),
        F.col("toxic").cast("int").alias("rejected"), flag((i % 29 == 0) & (F.col("quality") == 1)).alias("offer"), F.when(i % 4 == 0, F.lit("note")).otherwise(F.lit(" ")).alias("notes"),
    )


OUTCOMES = """outcomes AS (SELECT doc_id AS job_id, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS referral, quality AS callback, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS ghosted,
 toxic AS rejected, CASE WHEN doc_id % 29 = 0 AND quality = 1 THEN 1 ELSE 0 END AS offer, CASE WHEN doc_id % 4 = 0 THEN 'note' ELSE ' ' END AS notes FROM labels)"""

STATS = """applied AS (SELECT j.*, o.* FROM jobs j JOIN outcomes o ON j.id = o.job_id WHERE j.status = 'applied' OR j.applied_at IS NOT NULL),
 per AS (SELECT ats_platform, CAST(sum(callback) AS BIGINT) AS callbacks, count(*) AS applied FROM applied GROUP BY ats_platform),
 total AS (SELECT coalesce(CAST(sum(callback) AS DOUBLE) / nullif(count(*), 0), 0.0) AS global_rate, count(*) AS global_applied FROM applied)"""


def _day(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST(substr({x}, 1, 10) AS DATE) END)"


GIVEN = "coalesce(nullif(posted_at, ''), discovered_at)"
RANKED = f"""figures AS (SELECT j.*, coalesce(p.callbacks, 0) AS callbacks, coalesce(p.applied, 0) AS applied, global_rate, global_applied,
  date_diff('day', {_day(GIVEN)}, DATE '{AS_OF}') AS days, CASE WHEN global_rate > 0 THEN global_rate ELSE 0.1 END AS g FROM jobs j LEFT JOIN per p USING (ats_platform) CROSS JOIN total),
 parts AS (SELECT *, CASE WHEN days IS NULL THEN 0.9::DOUBLE WHEN days <= 30 THEN 1.0::DOUBLE ELSE greatest(0.8::DOUBLE, 1 - CAST(days - 30 AS DOUBLE) / 90 * 0.2::DOUBLE) END AS decay,
  CASE WHEN global_applied >= 30 THEN greatest(0.8::DOUBLE, least(1.25::DOUBLE, 0.5::DOUBLE + (callbacks + g * 10) / (applied + 10) / g * 0.5::DOUBLE)) ELSE 1.0::DOUBLE END AS factor FROM figures),
 ranked AS (SELECT *, CASE WHEN fit_score IS NULL THEN NULL WHEN coalesce(gated, 0) = 1 THEN fit_score * 0.05::DOUBLE
  ELSE least(100.0::DOUBLE, greatest(0.0::DOUBLE, least(100.0::DOUBLE, CASE WHEN desirability_score IS NOT NULL THEN desirability_score * 0.7::DOUBLE + fit_score * 0.3::DOUBLE ELSE fit_score END)) * decay * factor) END AS live_rank,
  CASE WHEN desirability_score IS NOT NULL THEN desirability_score * 0.5::DOUBLE + fit_score * 0.5::DOUBLE ELSE fit_score END * decay * factor AS legacy FROM parts)"""
RANK_SQL = f"WITH {JOBS}, {OUTCOMES}, {STATS}, {RANKED}"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages, with token counts of a quarter of their length."""
    tokens = F.floor(F.length("text") / 4).cast("long")
    mine = F.col("role") == "assistant"
    return table(prepare(spark), sf_dir, "conversations").select(
        F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"),
        F.when(mine, F.lit(0)).otherwise(tokens).cast("long").alias("input_tokens"), F.when(mine, tokens).otherwise(F.lit(0)).cast("long").alias("output_tokens"),
    )


MESSAGES = """messages AS (SELECT conv_id AS session_id, turn, role, text AS content, CASE WHEN role = 'assistant' THEN 0 ELSE length(text) // 4 END AS input_tokens,
 CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END AS output_tokens FROM conversations)"""


def unescaped_sql(text: str) -> str:
    """The relation plain (page_id, text) of pages with the references of a text decoded: it is cut at ampersands, and each piece behind one loses the reference that it starts with, by the standard's table of names."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    table_of_names = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in html5.items())
    return f"""names AS (SELECT map_from_entries([{table_of_names}]) AS m),
 pieces AS (SELECT page_id, string_split({text}, '&') AS p FROM pages),
 named AS (SELECT page_id, p[1] AS head, list_transform(p[2:], lambda x: {{'x': x, 'number': regexp_extract(x, '^#([0-9]+);?', 1), 'hex': regexp_extract(x, '^#[xX]([0-9a-fA-F]+);?', 1), 'whole': regexp_extract(x, '^[A-Za-z][A-Za-z0-9]*;'), 'open': regexp_extract(x, '^({'|'.join(OPEN_NAMES)})')}}) AS t FROM pieces),
 plain AS (SELECT page_id, head || array_to_string(list_transform(t, lambda s: CASE WHEN s.number <> '' THEN chr(CAST(s.number AS INTEGER)) || regexp_replace(s.x, '^#[0-9]+;?', '') WHEN s.hex <> '' THEN chr(CAST('0x' || s.hex AS INTEGER)) || regexp_replace(s.x, '^#[xX][0-9a-fA-F]+;?', '')
   WHEN m[s.whole] IS NOT NULL THEN m[s.whole] || substr(s.x, length(s.whole) + 1) WHEN m[s.open] IS NOT NULL THEN m[s.open] || substr(s.x, length(s.open) + 1) ELSE '&' || s.x END), '') AS text FROM named, names)"""
