"""Deduplication of incoming rows; 'first' always means by an explicit position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import Scratch, saved


def first_per_key(rows: DataFrame, key: str, pos: str, tie: str | None = None) -> DataFrame:
    w = Window.partitionBy(key).orderBy(pos, *([tie] if tie else []))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").select(key).distinct(), key, "left_anti")


def unwatched(rows: DataFrame, watched: DataFrame, name: str = "company") -> DataFrame:
    """rows whose name, trimmed and in lower case, is not watched."""
    w = watched.select(F.lower(F.trim(name)).alias("_name")).distinct()
    return rows.withColumn("_name", F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))).join(w, "_name", "left_anti").drop("_name")


def label_incoming(rows: DataFrame, seen: DataFrame, watched: DataFrame, *, key: str = "dedupe_key", pos: str = "pos", company: str = "company") -> DataFrame:
    """rows with an outcome: seen, duplicate, watched or fresh, in this order of precedence.

    Rows of watched companies do not make later rows of their key duplicates. Null keys are one key. What a key first counts at is a minimum, summed
    up before the shuffle, so a key on very many rows, or null ones, is no window in one task.
    """
    s = seen.where(F.coalesce(F.col(key), F.lit("")) != "").select(key).distinct().withColumn("_seen", F.lit(True))
    w = watched.select(F.lower(F.trim(company)).alias("_name")).distinct().withColumn("_watched", F.lit(True))
    both = rows.withColumn("_name", F.lower(F.trim(F.coalesce(F.col(company), F.lit(""))))).join(s, key, "left").join(w, "_name", "left")
    counts = F.col("_seen").isNull() & F.col("_watched").isNull()
    first = both.where(counts).groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.col(key).isNull().alias("_null")).agg(F.min(pos).alias("_first"))
    same = F.coalesce(F.col(key).cast("string"), F.lit("")) == F.col("_key")
    both = both.join(first, same & (F.col(key).isNull() == F.col("_null")), "left")
    outcome = F.when(F.col("_seen"), "seen").when(F.col("_first") < F.col(pos), "duplicate").when(F.col("_watched"), "watched").otherwise("fresh")
    return both.withColumn("outcome", outcome).select(*rows.columns, "outcome")


def capped(rows: DataFrame, group: str, pos: str, cap: int) -> DataFrame:
    """At most so many rows of each group, in order."""
    w = Window.partitionBy(group).orderBy(pos)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def poll(postings: DataFrame, seen: DataFrame, *, denied: Column, allowed: Column, long_enough: Column, max_new: int, key: str = "dedupe_key", target: str = "target_id", pos: str = "pos", dry_run: bool = False) -> DataFrame:
    """postings with the reason why each left the walk of its target: seen, duplicate, denied, region, capped, short, scored or unread.

    A target is walked in order. Known keys, denied titles and regions are passed over; then, once max_new postings are scored,
    the walk stops (capped), and what lies behind is unread. Only scored postings make later ones of their key
    duplicates, in their own target and in those after it; in a dry run none do. A null key is never a duplicate.

    Within a target that is a matter of windows. Whether a key was scored in a target before depends on the walks before, so
    the targets that hold a key whose first target has changed walk again, until none does: one more time than walks depend on each
    other in a row, and as often as there are targets at most. Walks move narrow rows (target, pos, key and four flags); texts meet
    their reasons once, at the end, by target and pos, which together name a posting.
    """
    s = seen.where(F.coalesce(F.col(key), F.lit("")) != "").select(key).distinct().withColumn("_seen", F.lit(True))
    flags = {"_denied": denied, "_region": ~allowed, "_long": long_enough}
    narrow = postings.join(s, key, "left").select(F.col(key).alias("_key"), F.col(target).alias("_target"), F.col(pos).alias("_pos"), F.coalesce("_seen", F.lit(False)).alias("_seen"), *(F.coalesce(c, F.lit(False)).alias(k) for k, c in flags.items()))
    with Scratch(postings.sparkSession) as scratch:
        rows = scratch.save(narrow)
        walked = scratch.save(_walk(rows.withColumn("_before", F.lit(False)), max_new, dry_run))
        used, now = None, scratch.save(_firsts(walked))
        while not dry_run:
            changed = now.withColumn("_used", F.lit(None).cast(now.schema["_first"].dataType)) if used is None else used.withColumnRenamed("_first", "_used").join(now, "_key", "full")
            earlier = lambda c: F.coalesce(F.col(c) < F.col("_target"), F.lit(False))
            touched = scratch.save(rows.join(changed.where(~F.col("_first").eqNullSafe(F.col("_used"))), "_key").where(earlier("_first") != earlier("_used")).select("_target").distinct())
            if touched.isEmpty():
                break
            part = rows.join(touched, "_target", "left_semi").join(now, "_key", "left").withColumn("_before", earlier("_first")).drop("_first")
            walked = scratch.save(walked.join(touched, "_target", "left_anti").unionByName(_walk(part, max_new, dry_run)))
            used, now = now, scratch.save(_firsts(walked))
        reasons = saved(walked.select("_target", "_pos", "exit_reason"))
    return postings.join(reasons, F.col(target).eqNullSafe(F.col("_target")) & (F.col(pos) == F.col("_pos"))).select(*postings.columns, "exit_reason")


def _firsts(walked: DataFrame) -> DataFrame:
    """The first target in which each key was scored."""
    return walked.where((F.col("exit_reason") == "scored") & F.col("_key").isNotNull()).groupBy("_key").agg(F.min("_target").alias("_first"))


def _walk(rows: DataFrame, max_new: int, dry_run: bool) -> DataFrame:
    """One walk of targets, _before telling whether a row's key was scored in a target before."""
    order = Window.partitionBy("_target").orderBy("_pos")
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    passes = ~F.col("_seen") & ~F.col("_before") & ~F.col("_denied") & ~F.col("_region")
    good = (passes & F.col("_long")).cast("int")
    twin = F.col("_key").isNotNull() & (F.coalesce(F.sum(good).over(so_far(Window.partitionBy("_target", "_key").orderBy("_pos"))), F.lit(0)) > 0)
    rows = rows.withColumn("_dup", F.col("_before") | (twin if not dry_run else F.lit(False)))
    reached = passes & ~F.col("_dup")
    rows = rows.withColumn("_n", F.coalesce(F.sum((reached & F.col("_long")).cast("int")).over(so_far(order)), F.lit(0)))
    stop = (reached & (F.col("_n") >= max_new)).cast("int")
    rows = rows.withColumn("_stops", F.coalesce(F.sum(stop).over(so_far(order)), F.lit(0)))
    reason = (
        F.when(F.col("_stops") > 0, "unread").when(F.col("_seen"), "seen").when(F.col("_dup"), "duplicate").when(F.col("_denied"), "denied").when(F.col("_region"), "region")
        .when(F.col("_n") >= max_new, "capped").when(~F.col("_long"), "short").otherwise("scored")
    )
    return rows.select("_key", "_target", "_pos", reason.alias("exit_reason"))
