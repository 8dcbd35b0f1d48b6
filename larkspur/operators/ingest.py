"""What happens to postings that come in: details joined late, known scores returned, the rest scored, stored and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.urls import canonical_url, dedupe_key
from larkspur.session import saved

from .merge import upsert_jobs

#: Shorter descriptions are not scored.
MIN_SCORED = 100


def with_details(postings: DataFrame, details: DataFrame, url: str = "url") -> DataFrame:
    """postings with description and posted_at filled in from their details (url, description, posted_at) where they have none. Filter first: the join comes last."""
    d = details.select(F.col(url), F.col("description").alias("_description"), F.col("posted_at").alias("_posted_at")).dropDuplicates([url])
    both = postings.join(d, url, "left")
    filled = F.coalesce(F.nullif("description", F.lit("")), "_description", F.lit(""))
    return both.withColumns({"description": filled, "posted_at": F.coalesce("posted_at", "_posted_at")}).drop("_description", "_posted_at")


def known_keys(snapshots: DataFrame, *, empty_counts: bool) -> DataFrame:
    """The seen keys of snapshots (dedupe_keys, urls): those listed, else made from the addresses.

    empty_counts: whether an empty list is an answer, as for the poller; discovery takes it for none.
    """
    keys, urls = F.col("dedupe_keys"), F.coalesce("urls", F.array().cast("array<string>"))
    listed = F.filter(F.coalesce(keys, F.array().cast("array<string>")), lambda k: k != "")
    made = F.transform(urls, lambda u: dedupe_key(u))
    given = keys.isNotNull() if empty_counts else F.size(listed) > 0
    each = snapshots.select(*(c for c in snapshots.columns if c not in ("dedupe_keys", "urls")), F.explode(F.when(given, listed).otherwise(made)).alias("key"))
    return each.where(F.coalesce("key", F.lit("")) != "").distinct()


def ingest(current: DataFrame, incoming: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Responses (pos, url, dedupe_key, outcome, fit_score) to incoming postings, and the postings afterwards.

    incoming: pos, url, title, company, description, ats_platform, posted_at, fit_score, force. scores: url, fit_score,
    desirability_score, gated, what a scorer answers. A posting without an address is an error; pasted ones get
    addresses of their own. One that brings no score and is not forced gets the score that its key has already, from
    current or from one before it. Others are scored where their description is long enough, and stored.
    """
    pasted = F.startswith("url", F.lit("manual-paste"))
    own = F.trim(F.coalesce("url", F.lit("")))
    rows = incoming.withColumn("url", F.when(pasted, F.concat(F.lit("manual-paste-"), F.col("pos").cast("string"))).otherwise(canonical_url(own)))
    # Written in between, as addresses and keys are large expressions that must not be copied into every use of them.
    rows = saved(saved(rows).withColumn("dedupe_key", dedupe_key(F.col("url"))))
    before = current.where(F.col("fit_score").isNotNull()).groupBy("dedupe_key").agg(F.min_by("fit_score", "id").alias("_known"))
    answer = scores.select(canonical_url(F.col("url")).alias("url"), F.col("fit_score").alias("_scored"), "desirability_score", "gated").dropDuplicates(["url"])
    rows = rows.join(before, "dedupe_key", "left").join(answer, "url", "left")
    scored = F.when(F.length("description") >= MIN_SCORED, F.col("_scored"))
    rows = rows.withColumn("_fit", F.coalesce("fit_score", scored))
    earlier = F.first("_fit", ignorenulls=True).over(Window.partitionBy("dedupe_key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_earlier", F.coalesce("_known", earlier))
    cached = F.col("fit_score").isNull() & ~F.coalesce("force", F.lit(False)) & F.col("_earlier").isNotNull()
    outcome = F.when(F.col("url") == "", "error").when(cached, "cached").when(F.col("_fit").isNotNull(), "scored").otherwise("stored")
    rows = rows.withColumn("outcome", outcome).withColumn("_result", F.when(F.col("outcome") == "cached", F.col("_earlier")).otherwise(F.col("_fit")))
    responses = rows.select("pos", "url", "dedupe_key", "outcome", F.when(F.col("outcome") != "error", F.col("_result")).alias("fit_score"))
    given = rows.where(F.col("outcome").isin("scored", "stored"))
    new = given.select("pos", "url", "dedupe_key", "title", "company", "description", "ats_platform", "posted_at", F.col("_fit").alias("fit_score"), *(F.when(F.col("fit_score").isNull(), F.col(c)).alias(c) for c in ("desirability_score", "gated")))
    missing = [c for c in current.columns if c not in (*new.columns, "id", "status", "applied_at")]
    new = new.select("*", *(F.lit(None).cast(dict(current.dtypes)[c]).alias(c) for c in missing))
    after = upsert_jobs(current, new, kept=tuple(c for c in ("status", "applied_at") if c in current.columns))
    touched = new.groupBy("dedupe_key").agg(F.max(F.col("fit_score").isNotNull()).alias("_ranked"))
    status = F.when(F.col("status").isin("discovered", "ranked") & F.col("_ranked").isNotNull(), F.when(F.col("_ranked"), "ranked").otherwise("discovered")).otherwise(F.col("status"))
    return responses, after.join(touched, "dedupe_key", "left").withColumn("status", status).select(current.columns)


def missing_desirability(jobs: DataFrame, limit: int) -> DataFrame:
    """The open postings with the best fit that have no desirability yet."""
    open_ = jobs.where(F.col("status").isin("discovered", "ranked") & F.col("fit_score").isNotNull() & F.col("desirability_score").isNull())
    return open_.orderBy(F.desc_nulls_last("fit_score"), "id").limit(limit)


def missing_gates(jobs: DataFrame, limit: int, analysis: str = "analysis_json", rank: str = "rank_score") -> DataFrame:
    """The best ranked postings, applied ones too, whose analysis says nothing of gates."""
    told = F.coalesce(F.contains(F.lower(analysis), F.lit('"gate_failures"')), F.lit(False))
    own = jobs.where(F.col("status").isin("discovered", "ranked", "applied") & F.col("fit_score").isNotNull() & ~told)
    return own.orderBy(F.desc_nulls_last(rank), "id").limit(limit)


def rescored(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Bounded rows with the scorer's answers (url, fit_score, desirability_score, gated), and what became of each: skipped without a description, failed without an answer, else done."""
    new = scores.select("url", F.col("fit_score").alias("_fit"), F.col("desirability_score").alias("_desirability"), F.col("gated").cast("int").alias("_gated")).dropDuplicates(["url"])
    both = rows.join(new, "url", "left")
    outcome = F.when(F.coalesce(F.length("description"), F.lit(0)) < MIN_SCORED, "skipped").when(F.col("_fit").isNull(), "failed").otherwise("done")
    done = F.col("outcome") == "done"
    take = lambda c, old: F.when(done, F.coalesce(c, old)).otherwise(F.col(old))
    return both.withColumn("outcome", outcome).withColumns({"fit_score": take("_fit", "fit_score"), "desirability_score": take("_desirability", "desirability_score"), "gated": F.when(done, F.coalesce("_gated", F.lit(0))).otherwise(F.col("gated"))}).drop("_fit", "_desirability", "_gated")


def extraction(scraped: Column, fetched: Column, least: int = 200) -> Column:
    """The text that a board's own interface gave, if it is longer than what a shell page has, else the scraped one."""
    return F.when(F.length(fetched) > least, fetched).otherwise(scraped)


def longest(elements: Column, below: int = 50_000) -> Column:
    """The longest element under a length, of equal ones the first; null if all are empty."""
    fits = F.filter(elements, lambda x: (F.length(x) > 0) & (F.length(x) < below))
    return F.aggregate(fits, F.lit(None).cast("string"), lambda best, x: F.when(F.length(x) > F.coalesce(F.length(best), F.lit(0)), x).otherwise(best))
