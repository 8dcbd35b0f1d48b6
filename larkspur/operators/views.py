"""Composed views: the ranked inbox, re-ranking, the backtest of formulas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.dates import age_label
from larkspur.functions.ranking import legacy_score, rank_score, shown
from larkspur.functions.rows import badge_color, normalised_analysis, recommendation
from larkspur.session import once, saved

from .filters import MAX_LISTED
from .phrases import match
from .stats import applied_outcomes, board_positions


def with_stats(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """jobs with the figures of their platform and of all platforms.

    Outcomes are summed once by platform; the sums of all platforms, a list that people keep, travel as one row with every job, so that
    jobs are neither shuffled nor gathered by the few platforms there are. A platform that is unknown has no figures.
    """
    sums = applied_outcomes(jobs, outcomes).groupBy("ats_platform").agg(F.coalesce(F.sum("callback"), F.lit(0)).cast("long").alias("callbacks"), F.count("*").alias("applied"))
    rate = F.coalesce(F.try_divide(F.sum("callbacks"), F.sum("applied")), F.lit(0.0)).cast("double")
    known = F.collect_list(F.when(F.col("ats_platform").isNotNull(), F.struct(F.col("ats_platform").alias("key"), F.struct("callbacks", "applied").alias("value"))))
    total = sums.agg(rate.alias("global_rate"), F.coalesce(F.sum("applied"), F.lit(0)).alias("global_applied"), known.alias("_known"))
    bounded = F.when(F.size("_known") > MAX_LISTED, F.raise_error(F.lit(f"more than {MAX_LISTED} platforms"))).otherwise(F.map_from_entries("_known"))
    both = jobs.join(F.broadcast(total.withColumn("_known", bounded)), F.lit(True)).withColumn("_own", F.try_element_at("_known", F.col("ats_platform")))
    return both.withColumns({c: F.coalesce(F.col(f"_own.{c}"), F.lit(0)) for c in ("callbacks", "applied")}).drop("_known", "_own")


def company_adjustment(rows: DataFrame, adjustments: DataFrame, company: str = "company") -> DataFrame:
    """rows with an adjustment: that of the company's own name, else of the first listed name that is part of it, else 0.

    adjustments: pos, name and points. Names are looked for by automata, so the list may be long (`phrases.match`); of equal names the first counts. Different companies are looked up once each.
    """
    own = F.lower(F.trim(F.coalesce(F.col(company), F.lit(""))))
    listed = adjustments.select(F.lower(F.trim("name")).alias("_name"), F.struct("pos", F.col("points").cast("double").alias("points")).alias("x"))
    firsts = listed.groupBy("_name").agg(F.min("x").alias("x")).select("_name", "x.pos", "x.points")
    points = lambda name: firsts.select(F.col("_name").alias(f"_{name}_name"), F.col("points").alias(f"_{name}_points"))
    names = match(rows.select(own.alias("_own")).distinct(), firsts, text="_own", phrase="_name", out="_within")
    names = names.join(points("own"), F.col("_own") == F.col("_own_name"), "left").join(points("part"), F.col("_within") == F.col("_part_name"), "left")
    known = names.select("_own", F.coalesce("_own_points", "_part_points", F.lit(0.0)).alias("adjustment"))
    return rows.drop("adjustment").join(known, own == F.col("_own"), "left").drop("_own")


def live_rank(jobs: DataFrame, outcomes: DataFrame, as_of: Column, *, preferences: bool = False, adjustment: Column | None = None) -> DataFrame:
    """jobs with live_rank, unrounded."""
    s = {c: F.col(c) for c in ("callbacks", "applied", "global_rate", "global_applied")}
    rank = rank_score(F.col("fit_score"), F.col("desirability_score"), F.col("gated"), F.col("posted_at"), F.col("discovered_at"), as_of, adjustment=adjustment, preferences=preferences, **s)
    return with_stats(jobs, outcomes).withColumn("live_rank", rank)


def reranked(jobs: DataFrame, outcomes: DataFrame, as_of: Column, **options) -> DataFrame:
    """jobs with their rank written back."""
    return live_rank(jobs, outcomes, as_of, **options).withColumn("rank_score", F.col("live_rank")).select(jobs.columns)


def inbox(jobs: DataFrame, outcomes: DataFrame, as_of: Column, statuses: tuple[str, ...] = ("discovered", "ranked")) -> DataFrame:
    """Rows of the statuses with rank, label and age, best first."""
    ranked = live_rank(jobs, outcomes, as_of).where(F.col("status").isin(*statuses))
    out = ranked.select("id", "status", "ats_platform", "fit_score", "desirability_score", shown(F.col("live_rank")).alias("rank"), recommendation(F.col("fit_score")).alias("recommendation"), age_label(F.col("posted_at"), F.col("discovered_at"), as_of).alias("age"), "live_rank")
    return out.orderBy(F.desc(F.coalesce("live_rank", F.lit(-1.0))), F.desc(F.coalesce("fit_score", F.lit(0.0))), F.desc("id")).drop("live_rank")


def decorated(jobs: DataFrame, outcomes: DataFrame, as_of: Column, analysis: str = "analysis_json") -> DataFrame:
    """jobs as a page shows them: with rank, recommendation (the analysis' own, else that of the score), age, colour, and the analysis under one set of names.

    A null analysis, or one that is malformed, has an empty summary and empty lists. Columns of these names are replaced.
    """
    ranked = once(live_rank(jobs, outcomes, as_of), _a=normalised_analysis(F.col(analysis)))
    made = {
        "rank": shown(F.col("live_rank")), "recommendation": F.coalesce(F.nullif(F.col("_a.recommendation"), F.lit("")), recommendation(F.col("fit_score"))), "age": age_label(F.col("posted_at"), F.col("discovered_at"), as_of),
        "color": badge_color(F.col("desirability_score")), "summary": F.col("_a.summary"), "strengths": F.col("_a.strengths"), "gaps": F.col("_a.gaps"),
    }
    return ranked.withColumns(made).select(*(c for c in jobs.columns if c not in (*made, analysis)), *made)


def high_priority(jobs: DataFrame, outcomes: DataFrame, as_of: Column, fit_min: float, rank_min: float) -> DataFrame:
    open_ = live_rank(jobs, outcomes, as_of).where(F.col("status").isin("discovered", "ranked"))
    return open_.where((F.col("fit_score") > fit_min) & (F.col("live_rank") > rank_min))


def backtest(jobs: DataFrame, outcomes: DataFrame, as_of: Column, top: int = 5) -> DataFrame:
    """For both formulas: how many applied postings would be among the board's first places, and how many have no desirability yet.

    Ranks are made once and written as narrow rows, which the counts, the board's histogram and the placing then read.
    """
    s = {c: F.col(c) for c in ("callbacks", "applied", "global_rate", "global_applied")}
    cols = [F.col(c) for c in ("fit_score", "desirability_score", "posted_at", "discovered_at")]
    both = live_rank(jobs, outcomes, as_of).withColumn("legacy", legacy_score(*cols, as_of, **s)).where(F.col("status").isin("discovered", "ranked", "applied"))
    formulas = F.array(*(F.struct(F.lit(name).alias("formula"), F.col(rank).alias("rank")) for name, rank in (("current", "live_rank"), ("legacy", "legacy"))))
    rows = both.select("id", (F.col("status") != "applied").alias("on_board"), F.col("fit_score").alias("fit"), F.col("desirability_score").isNull().alias("pending"), F.explode(formulas).alias("f"))
    rows = saved(rows.select("id", "on_board", "fit", "pending", "f.*"))
    counts = rows.where(~F.col("on_board")).groupBy("formula").agg(F.count("*").alias("n_applied"), F.sum(F.col("pending").cast("long")).alias("n_pending"))
    placed = board_positions(rows.where("on_board"), rows.where(~F.col("on_board")))
    hits = placed.groupBy("formula").agg(F.sum((F.col("position") <= top).cast("long")).alias("hits"), F.min("position").alias("best"))
    return counts.join(hits, "formula", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
