"""Predicates on postings, with the reason where one is dropped."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.dates import iso_date

from .phrases import match

# Regions that are allowed and denied unless settings say otherwise.
ALLOWED_LOCATIONS = ["United States", "USA", "U.S.", "US-", "US,", "US |", "Americas", "North America", "Locations"]
DENIED_LOCATIONS = [
    "Canada", "Toronto", "Montreal", "Vancouver", "United Kingdom", " UK ", "| UK", "UK |", "London", "Ireland", "Dublin", "Germany", "Berlin", "Munich",
    "Spain", "Barcelona", "Madrid", "Sweden", "Stockholm", "Netherlands", "Amsterdam", "France", "Paris", "Israel", "Tel Aviv", "Yokneam",
    "India", "Bengaluru", "Pune", "Hyderabad", "Mumbai", "Taiwan", "Taipei", "China", "Japan", "Tokyo", "Australia", "Sydney",
    "LATAM", "EMEA", "APAC", "ASEAN", "DACH", "ANZ",
]
TITLE_DROPS = "intern|internship|apprentice|new[- ]grad"
NO_TITLE = "no title"
#: Figures of platforms travel as one map with every row, up to this many.
MAX_LISTED = 10_000


def denied_phrase(title: Column, phrases: Column) -> Column:
    """The first phrase of an array that the title contains, in either case."""
    return F.get(F.filter(phrases, lambda p: (p != "") & F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lower(p))), 0)


def phrase_pattern(phrase: str) -> str:
    """A phrase as a pattern on lower-case text; one that starts with a letter or digit does not match inside a word."""
    low = phrase.lower()
    return ("(?<![a-z0-9])" if re.match("[a-z0-9]", low) else "") + "\\Q" + low + "\\E"


def matched_phrase(text: Column, phrases: list[str]) -> Column:
    """The first of the phrases that the text has."""
    low = F.lower(text)
    return F.coalesce(*(F.when(F.rlike(low, F.lit(phrase_pattern(p))), F.lit(p)) for p in phrases), F.lit(None).cast("string"))


def location_verdict(location: Column, allow: list[str] = ALLOWED_LOCATIONS, deny: list[str] = DENIED_LOCATIONS) -> Column:
    """allowed, and the reason of a denial. Allowed phrases win over denied ones; no match is allowed."""
    denied = matched_phrase(location, deny)
    ok = (F.trim(F.coalesce(location, F.lit(""))) == "") | matched_phrase(location, allow).isNotNull() | denied.isNull()
    return F.struct(ok.alias("allowed"), F.when(~ok, F.concat(F.lit("deny:"), denied)).alias("reason"))


def csv_or_default(raw: Column, default: list[str]) -> Column:
    """The listed values; the default only where nothing is set, as an empty text is an empty list."""
    parts = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(raw.isNotNull(), parts).otherwise(F.array(*map(F.lit, default)))


def long_enough(text: Column, least: int = 100) -> Column:
    return F.coalesce(F.length(text) >= least, F.lit(False))


def title_drop(title: Column, extra: list[str] = ()) -> Column:
    """Why a title is dropped: the word in it, the general ones first, or that there is none. A title is read once, or once more where only words of its own list are in it."""
    word = lambda terms: F.nullif(F.lower(F.regexp_extract(title, f"(?i)(?U)\\b({terms})\\b", 1)), F.lit(""))
    more = [word("|".join("\\Q" + t + "\\E" for t in extra))] if extra else []
    blank = title.isNull() | ~F.rlike(title, F.lit("(?U)\\S"))
    return F.when(blank, F.lit(NO_TITLE)).otherwise(F.coalesce(word(TITLE_DROPS), *more))


def code_status(revoked: Column, expires: Column, as_of: Column) -> Column:
    """ok, expired (which an unreadable date counts as) or revoked."""
    fresh = (F.coalesce(expires, F.lit("")) == "") | F.coalesce(iso_date(expires) >= as_of, F.lit(False))
    return F.when(F.coalesce(revoked, F.lit(0)) != 0, "revoked").when(~fresh, "expired").otherwise("ok")


def access_granted(status: Column, attempts_ok: Column, by_url: Column, url_auth: Column) -> Column:
    return attempts_ok & (status == "ok") & (~by_url | (F.coalesce(url_auth, F.lit(0)) == 1))


def cleanup_candidates(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Open postings of which nothing came: no outcome row, or one without flags and notes."""
    flags = ["referral", "callback", "ghosted", "rejected", "offer"]
    both = jobs.where(F.col("status").isin("discovered", "ranked")).join(outcomes.withColumnRenamed("job_id", "id"), "id", "left")
    idle = F.coalesce(F.trim("notes"), F.lit("")) == ""
    for f in flags:
        idle = idle & (F.coalesce(F.col(f), F.lit(0)) == 0)
    return both.where(idle).select(*(jobs[c] for c in jobs.columns if c != "id"), "id")


def cleanup_decision(candidates: DataFrame, dead: DataFrame, as_of: Column, days: int = 35) -> DataFrame:
    """Candidates that go: by age, or else because their address is known to be dead."""
    days = min(max(days, 1), 365)
    old = F.coalesce(F.col("discovered_at").cast("timestamp") < F.date_sub(as_of, days).cast("timestamp"), F.lit(False))
    gone = dead.select("id", F.lit(True).alias("dead")).distinct()
    reason = F.when(old, "age").when(F.col("dead"), "dead")
    return candidates.join(gone, "id", "left").withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("dead")


def lint(lines: DataFrame, needles: DataFrame) -> DataFrame:
    """The first hit: the least path, then line, then needle order. lines: path, line_no, line. needles: pos, needle; all are looked for in one pass over a line, whatever their number."""
    hits = match(lines.select("path", "line_no", "line"), needles, text="line", phrase="needle", out="needle").where(F.col("needle").isNotNull())
    return hits.select("path", "line_no", F.lower("needle").alias("needle")).orderBy("path", "line_no").limit(1)
