"""The staged screen: rules, triage, gates. Models' answers are input columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.session import once

from .filters import NO_TITLE, long_enough, title_drop

# Families that are kept.
KEEP_FAMILIES = ["platform", "devops", "build-release", "developer-experience", "infrastructure", "sre"]
MIN_SKETCH = 25


def screen(postings: DataFrame, *, extra_titles: list[str] = (), min_length: int = 200) -> DataFrame:
    """postings with stage, keep and reason. Columns: title, description, family, triage_error, gate_failures, worth, fit_sketch, gate_error.

    A failed triage passes; a failed gate keeps the posting as an error.
    """
    rows = once(postings, _word=title_drop(F.col("title"), extra_titles))
    word = F.col("_word")
    gates = F.filter("gate_failures", lambda g: F.coalesce(F.trim(g["evidence"]), F.lit("")) != "")
    stage = (
        F.when(word.isNotNull() | ~long_enough(F.col("description"), min_length), "rules")
        .when(F.col("triage_error").isNull() & ~F.coalesce(F.col("family").isin(KEEP_FAMILIES), F.lit(False)), "triage")
        .when(F.col("gate_error").isNotNull(), "error")
        .otherwise("gates")
    )
    low = ~F.coalesce(F.col("worth"), F.lit(False)) & (F.coalesce("fit_sketch", F.lit(0)) < MIN_SKETCH)
    out = rows.withColumn("stage", stage).withColumn("n_gates", F.coalesce(F.size(gates), F.lit(0)))
    out = out.withColumn("keep", (F.col("stage") == "error") | ((F.col("stage") == "gates") & (F.col("n_gates") <= 0) & ~low))
    reason = (
        F.when((F.col("stage") == "rules") & (word == NO_TITLE), F.lit(NO_TITLE))
        .when((F.col("stage") == "rules") & word.isNotNull(), F.concat(F.lit("title:"), word))
        .when(F.col("stage") == "rules", F.lit("short"))
        .when(F.col("stage") == "triage", F.concat(F.lit("family:"), F.coalesce("family", F.lit("none"))))
        .when(F.col("stage") == "error", F.lit("error"))
        .when(F.col("n_gates") > 0, F.lit("gate"))
        .when(~F.col("keep"), F.lit("sketch"))
        .otherwise(F.lit("kept"))
    )
    return out.withColumn("reason", reason).select(*postings.columns, "stage", "n_gates", "keep", "reason")


def submittable(decisions: DataFrame, cap: int = 25) -> DataFrame:
    """Kept decisions that are no errors, the best first."""
    return decisions.where(F.col("keep") & (F.col("stage") != "error")).orderBy(F.desc(F.coalesce("fit_sketch", F.lit(0))), "pos").limit(cap)


SENIOR = "(?i)(?U)\\b(senior|sr|lead)\\b"


def screen_single(postings: DataFrame, *, extra_titles: list[str] = (), min_length: int = 200) -> DataFrame:
    """The screen of single postings: as `screen`, but the triage model's own verdict counts (triage_keep), unless it is unsure of the level
    (triage_level) or the title speaks of seniority; what a model failed on is kept as an error; stage is kept for those that pass.
    """
    title = F.trim(F.coalesce("title", F.lit("")))
    rows, word = once(postings, _word=title_drop(title, extra_titles)), F.col("_word")
    gates = F.filter("gate_failures", lambda g: F.coalesce(F.trim(g["evidence"]), F.lit("")) != "")
    unsure = F.coalesce(F.col("triage_level") == "unclear", F.lit(False)) | F.rlike(title, F.lit(SENIOR))
    fit = F.coalesce("fit_sketch", F.lit(0))
    low = ~F.coalesce(F.col("worth"), F.lit(False)) & (fit < MIN_SKETCH)
    stage = (
        F.when(word.isNotNull() | ~long_enough(F.trim("description"), min_length), "rules")
        .when(F.col("triage_error").isNotNull(), "error")
        .when(~F.coalesce(F.col("triage_keep"), F.lit(False)) & ~unsure, "triage")
        .when(F.col("gate_error").isNotNull(), "error")
        .when((F.coalesce(F.size(gates), F.lit(0)) > 0) | low, "gates")
        .otherwise("kept")
    )
    return rows.withColumn("stage", stage).withColumn("keep", F.col("stage").isin("error", "kept")).select(*postings.columns, "stage", "keep")
