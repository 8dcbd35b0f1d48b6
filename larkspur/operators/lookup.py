"""Lookups that go to a cache first, and what a cache keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds for which a miss is remembered and for which a conversation goes on; entries that a cache holds.
MISS_SECONDS, TURNS_SECONDS, MOST_ENTRIES = 600, 1800, 500


def cached_scores(asked: DataFrame, cache: DataFrame, store: DataFrame, now: Column, miss_seconds: int = MISS_SECONDS) -> DataFrame:
    """asked (key) with a score and where it comes from.

    cache: key, score (null for a miss that is remembered) and at. A cached score counts at any age; a remembered miss only for
    a while, in which the store (key, score) is not asked.
    """
    entries = cache.groupBy("key").agg(F.max(F.struct("at", "score")).alias("e")).select("key", F.lit(True).alias("_has"), F.col("e.at").alias("_at"), F.col("e.score").alias("_cached"))
    both = asked.join(entries, "key", "left").join(store.select("key", F.col("score").alias("_stored")).dropDuplicates(["key"]), "key", "left")
    held = F.col("_has") & F.col("_cached").isNull() & (F.unix_timestamp(now) - F.unix_timestamp("_at") < miss_seconds)
    source = F.when(F.col("_cached").isNotNull(), "cache").when(held, "known miss").when(F.col("_stored").isNotNull(), "store").otherwise("miss")
    out = both.withColumn("source", F.coalesce(source, F.lit("miss")))
    return out.withColumn("score", F.when(F.col("source") == "cache", F.col("_cached")).when(F.col("source") == "store", F.col("_stored"))).drop("_has", "_at", "_cached", "_stored")


def kept_entries(entries: DataFrame, most: int = MOST_ENTRIES, key: str = "key", at: str = "at") -> DataFrame:
    """The entries that a cache of so many holds: the newest of each key, the oldest keys evicted."""
    newest = entries.groupBy(key).agg(F.max(at).alias(at))
    return newest.orderBy(F.desc(at), F.desc(key)).limit(most)


def last_turns(messages: DataFrame, now: Column, *, key: str, at: str, tie: str, turns: int = 12, seconds: int = TURNS_SECONDS) -> DataFrame:
    """The last turns of the conversations that were active within some seconds before now."""
    w = Window.partitionBy(key)
    live = messages.withColumn("_last", F.max(at).over(w)).where(F.unix_timestamp(now) - F.unix_timestamp("_last") <= seconds)
    return live.withColumn("_n", F.row_number().over(w.orderBy(F.desc(at), F.desc(tie)))).where(F.col("_n") <= turns).drop("_n", "_last")
