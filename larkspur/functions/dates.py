"""Tolerant dates and ages. as_of is always an argument."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(value: Column) -> Column:
    """The date that a text begins with (yyyy-MM-dd), else null."""
    text = value.cast("string")
    return F.when(F.rlike(text, F.lit("^\\d{4}-\\d{2}-\\d{2}")), F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).cast("date"))


def age_days(value: Column, as_of: Column) -> Column:
    return F.datediff(as_of, value)


def age_label(posted: Column, discovered: Column, as_of: Column) -> Column:
    """How old a posting is, in words, and by which date; a dash where no date can be read."""
    given = F.coalesce(F.nullif(posted.cast("string"), F.lit("")), discovered.cast("string"))
    days = F.datediff(as_of, iso_date(given))
    number = lambda x: F.floor(x).cast("string")
    span = (
        F.when(days <= 0, F.lit("today"))
        .when(days == 1, F.lit("1 day ago"))
        .when(days < 30, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(days < 90, F.concat(number(days / 7), F.lit("w ago")))
        .otherwise(F.concat(number(days / 30), F.lit("mo ago")))
    )
    return F.when(days.isNull(), F.lit("\u2014")).otherwise(F.concat(F.when(posted.isNull(), F.lit("discovered ")).otherwise(F.lit("posted ")), span))


def epoch_ms_date(ms: Column) -> Column:
    """The UTC day of milliseconds since the epoch."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ms / 86_400_000).cast("int"))
