"""Counters, limits and sessions by key and time."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.session import saved

# Requests an hour for a code, dollars a day for a code and for all, failures an hour for an address and for all.
REQUESTS_PER_HOUR, DOLLARS_PER_DAY, DOLLARS_PER_DAY_ALL, FAILURES_PER_HOUR, FAILURES_PER_HOUR_ALL = 60, 5.0, 25.0, 10, 100
HOUR, DAY = 3600, 86_400


def window_number(at: Column, size: int) -> Column:
    return F.floor(F.unix_timestamp(at) / size)


def counter(events: DataFrame, key: str, amount: Column, *, at: str = "ts", tie: str = "event_id", size: int = HOUR, out: str = "value") -> DataFrame:
    """events with the running amount of their key in their fixed window."""
    w = Window.partitionBy(key, window_number(F.col(at), size)).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(out, F.sum(amount).over(w))


def request_limit(events: DataFrame, key: str, limit: int = REQUESTS_PER_HOUR, **options) -> DataFrame:
    """Whether each request is within the limit; refused ones count on."""
    return counter(events, key, F.lit(1), out="n_requests", **options).withColumn("within", F.col("n_requests") <= limit)


def budget_limit(events: DataFrame, key: str, cost: Column, limit: float = DOLLARS_PER_DAY, **options) -> DataFrame:
    """Whether what was spent before each event is below the limit."""
    return counter(events, key, cost, size=DAY, out="spent_after", **options).withColumn("spent_before", F.col("spent_after") - cost).withColumn("within", F.col("spent_before") < limit)


def failure_limit(failures: DataFrame, key: str, limit: int = FAILURES_PER_HOUR, *, out: str = "within", **options) -> DataFrame:
    """Whether another try was allowed when each failure came: fewer failures than the limit before it in its hour."""
    return counter(failures, key, F.lit(1), out="_failures", **options).withColumn(out, F.col("_failures") - 1 < limit).drop("_failures")


def live_counters(counters: DataFrame, now: Column, size: int) -> DataFrame:
    """Counters of the current window; older ones expire."""
    return counters.where(F.col("window") >= window_number(now, size))


def sessions(events: DataFrame, key: str, *, at: str = "ts", tie: str = "event_id", gap_seconds: int = 12 * HOUR) -> DataFrame:
    """Sessions that end after a gap."""
    w = Window.partitionBy(key).orderBy(at, tie)
    new = F.coalesce((F.unix_timestamp(at) - F.unix_timestamp(F.lag(at).over(w)) > gap_seconds).cast("int"), F.lit(1))
    numbered = events.withColumn("_new", new).withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session_no").agg(F.min(at).alias("started_at"), F.max(at).alias("last_active_at"), F.count("*").alias("n_events"))


def newest(rows: DataFrame, at: str, n: int, key: str | None = None, tie: str = "id") -> DataFrame:
    """The n newest rows, of each key if one is given."""
    if key is None:
        return rows.orderBy(F.desc(at), F.desc(tie)).limit(n)
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def breaker(calls: DataFrame, key: str, bad: Column, order: str, after: int = 2) -> DataFrame:
    """Whether a key was already dead when each call was made: so many bad calls before it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("dead", F.coalesce(F.sum(bad.cast("int")).over(w), F.lit(0)) >= after)


def usage_summary(codes: DataFrame, sessions_: DataFrame, messages: DataFrame) -> DataFrame:
    """Sessions, messages, cost and last activity of each code. Messages are summed by session before they meet, so nothing fans out."""
    per = messages.groupBy("session_id").agg(F.count("*").alias("n_messages"), F.sum("cost_usd").alias("cost_usd"))
    own = sessions_.join(per, "session_id", "left").groupBy("code").agg(F.count("*").alias("n_sessions"), F.coalesce(F.sum("n_messages"), F.lit(0)).alias("n_messages"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"), F.max("last_active_at").alias("last_active_at"))
    return codes.select("code").join(own, "code", "left").select("code", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_sessions", "n_messages")), F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"), "last_active_at")


def running(events: DataFrame, amount: Column, by: list[str] = (), *, at: str = "ts", tie: str = "event_id", size: int | None = HOUR, out: str = "value") -> DataFrame:
    """events with the running amount in their fixed window, of all events or of those that agree in some columns; for keys that hold many rows, or all.

    Rows are sorted by ranges and written; a range's sums in each window it meets give what stands before the next ones, so a task holds a range
    and never a key. Without a size there is one window for all time. Null keys are a key; rows of equal time are ordered by tie.
    """
    keys = [f"_by{k}" for k in range(len(by))]
    own = events.withColumns({k: F.col(c) for k, c in zip(keys, by, strict=True)} | {"_window": F.lit(0) if size is None else window_number(F.col(at), size), "_amount": F.coalesce(amount, F.lit(0))})
    place = [*keys, "_window"]
    ranged = saved(own.repartitionByRange(*place, at, tie).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy(*place, "_part").agg(F.sum("_amount").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*place).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(*(F.col(c).alias(f"{c}_") for c in (*place, "_part")), before.alias("_before"))
    within = F.sum("_amount").over(Window.partitionBy(*place, "_part").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*place, "_part")]
    joined = ranged.withColumn("_within", within).join(offsets, reduce(and_, same))
    return joined.withColumn(out, F.col("_before") + F.col("_within")).select(*events.columns, out)
