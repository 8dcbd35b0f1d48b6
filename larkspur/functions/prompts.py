"""What a scorer is asked: the message for a posting and the shape of the answer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

#: Characters of a description that are sent to a paid scorer and to a local one.
MOST_PAID, MOST_LOCAL = 12_000, 24_000

ANSWER = StructType([
    StructField("candidate_score", DoubleType()), StructField("candidate_explanation", StringType()), StructField("candidate_strengths", ArrayType(StringType())),
    StructField("candidate_deficiencies", ArrayType(StringType())), StructField("job_description_score", DoubleType()), StructField("job_company_name", StringType()),
])
GATE = StructType([StructField("gate", StringType()), StructField("evidence", StringType())])
PREFERENCES = [StructField("desirability_score", DoubleType()), StructField("desirability_explanation", StringType()), StructField("pace_signals", ArrayType(StringType())), StructField("gate_failures", ArrayType(GATE))]


def answer_schema(preferences: bool) -> StructType:
    """The fields of an answer, with those on preferences if there are any; ANSWER itself stays as it is."""
    return StructType([*ANSWER.fields, *(PREFERENCES if preferences else [])])


def user_message(instruction: Column, description: Column, url: Column, title: Column, platform: Column, most: int = MOST_PAID) -> Column:
    """The message on a posting; missing parts are said to be so, a long description is cut, which is the scorer's price limit."""
    said = lambda x, other: F.coalesce(F.nullif(x, F.lit("")), F.lit(other))
    return F.concat(
        instruction, F.lit("\n\n<job_posting>\nURL: "), said(url, "n/a"), F.lit("\nTitle: "), said(title, "n/a"), F.lit("\nATS Platform: "), said(platform, "unknown"),
        F.lit("\nDescription:\n"), F.substring(F.coalesce(description, F.lit("")), 1, most), F.lit("\n</job_posting>"),
    )
