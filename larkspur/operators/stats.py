"""Aggregates over postings, outcomes and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def status_summary(jobs: DataFrame) -> DataFrame:
    n = lambda *s: F.coalesce(F.sum(F.col("status").isin(*s).cast("long")), F.lit(0)).alias
    return jobs.agg(n("discovered", "ranked")("n_open"), n("applied")("n_applied"), n("closed")("n_closed"), F.count("*").alias("n_total"))


def applied_outcomes(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Postings that were applied to and have an outcome row."""
    was = (F.col("status") == "applied") | F.col("applied_at").isNotNull()
    return jobs.where(was).join(outcomes, jobs["id"] == outcomes["job_id"])


def platform_stats(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Call-backs and applications of each platform."""
    own = applied_outcomes(jobs, outcomes).where(F.col("ats_platform").isNotNull())
    return own.groupBy("ats_platform").agg(F.coalesce(F.sum("callback"), F.lit(0)).cast("long").alias("callbacks"), F.count("*").alias("applied"))


def global_stats(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: the rate over all platforms and how many applications it rests on."""
    total, hits = F.count("*"), F.coalesce(F.sum("callback"), F.lit(0))
    return applied_outcomes(jobs, outcomes).agg(F.coalesce(F.try_divide(hits, total), F.lit(0.0)).cast("double").alias("global_rate"), total.alias("global_applied"))


def banner(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    rate = F.coalesce(F.try_divide(F.sum("callback") * 100.0, F.count("*")), F.lit(0.0))
    return applied_outcomes(jobs, outcomes).agg(F.count("*").alias("applied"), F.coalesce(F.sum("callback"), F.lit(0)).cast("long").alias("callbacks"), F.coalesce(F.sum("offer"), F.lit(0)).cast("long").alias("offers"), (F.floor(rate * 10 + 0.5) / 10).alias("rate_percent"))


def duplicate_keys(jobs: DataFrame, key: str = "dedupe_key") -> DataFrame:
    return jobs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def most_common(rows: DataFrame, by: str, pos: str, n: int) -> DataFrame:
    """The n most frequent values; ties keep the order in which they came first."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.min(pos).alias("first")).orderBy(F.desc("n"), "first").limit(n).drop("first")


def run_totals(walked: DataFrame, target: str = "target_id") -> DataFrame:
    """Counters of a run for each target, and over all of them where target is null."""
    n = lambda *r: F.sum(F.col("exit_reason").isin(*r).cast("long")).alias
    return walked.rollup(target).agg(F.count("*").alias("found"), n("seen", "duplicate")("skipped_seen"), n("denied")("denied"), n("region")("out_of_region"), n("short")("too_short"), n("capped")("capped"), n("scored")("scored"))


def systemic_failure(summaries: DataFrame) -> DataFrame:
    """1 if something was attempted and all of it failed."""
    tried = F.col("skipped") == 0
    attempted, failed = F.sum(tried.cast("long")), F.sum((tried & F.col("adapter_error")).cast("long"))
    return summaries.agg(F.when((attempted > 0) & (attempted == failed), 1).otherwise(0).alias("exit_code"))


#: Scores are counted in steps of this size; what lies within a step is sorted in one task.
STEP = 0.001


def board_positions(board: DataFrame, rows: DataFrame, by: str = "formula") -> DataFrame:
    """rows (by, id, rank, fit) with the position each would take on its board: one more than the strictly better entries. Rows without a rank have none.

    A histogram of the board's scores tells how many entries lie in better steps: scores end at 125, so it has a bounded number of
    rows. Entries of a row's own step are counted by a window over the distinct (rank, fit) of that step.
    """
    step = F.floor(F.col("rank") / STEP).cast("long")
    fit = F.coalesce("fit", F.lit(0.0))
    entries = board.where(F.col("rank").isNotNull()).groupBy(by, step.alias("step"), "rank", fit.alias("fit")).agg(F.count("*").alias("n"))
    asked = rows.where(F.col("rank").isNotNull()).select(by, "id", step.alias("step"), "rank", fit.alias("fit"))
    points = entries.unionByName(asked.select(by, "step", "rank", "fit", F.lit(0).cast("long").alias("n"))).groupBy(by, "step", "rank", "fit").agg(F.sum("n").alias("n"))
    ahead = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = points.withColumn("within", ahead(Window.partitionBy(by, "step").orderBy(F.desc("rank"), F.desc("fit"))))
    steps = points.groupBy(by, "step").agg(F.sum("n").alias("n")).withColumn("before", ahead(Window.partitionBy(by).orderBy(F.desc("step")))).drop("n")
    placed = within.join(steps, [by, "step"]).select(by, "step", "rank", "fit", (F.col("before") + F.col("within") + 1).alias("position"))
    return asked.join(placed, [by, "step", "rank", "fit"]).select(by, "id", "position")
