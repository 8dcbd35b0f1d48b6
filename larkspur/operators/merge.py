"""Merges of snapshots: each takes the current table and what is new and returns the next table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN = ("discovered", "ranked")
STATEFUL = ("applied", "closed")


def upsert_jobs(current: DataFrame, new: DataFrame, *, id: str = "id", key: str = "dedupe_key", url: str = "url", pos: str = "pos", kept: tuple[str, ...] = ("status", "applied_at", "branch"), first: str | None = None) -> DataFrame:
    """current after the rows of new were written one by one, in order of pos.

    A new row meets the current row (of several the one with the smallest id) that has its key or its address; rows that meet none
    are inserted, once for each key, or address where there is no key. New values win over old ones unless they are null, later
    ones over earlier ones; a key is only filled in where there was none, and kept columns never change. Inserted rows are
    discovered and have a null id, which the sink (`store.upsert`) gives out; first: a column for the pos of the row that each was first inserted by.
    """
    columns = [c for c in current.columns if c not in (id, key, *kept)]
    least = lambda c, name: current.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(id).alias(name))
    met = new.join(least(key, "_by_key"), key, "left").join(least(url, "_by_url"), url, "left").withColumn("_target", F.least("_by_key", "_by_url"))
    tag = lambda name, c: F.concat(F.lit(name), F.col(c).cast("string"))
    place = F.coalesce(tag("id:", "_target"), tag("key:", key), tag("url:", url), tag("pos:", pos))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(pos))).alias(c)
    folded = met.groupBy(place.alias("_place")).agg(F.first("_target").alias("_target"), F.min(pos).alias("_pos"), *(last(c) for c in (key, *columns)))
    c, n = current.alias("c"), folded.where(F.col("_target").isNotNull()).alias("n")
    updated = c.join(n, F.col(f"c.{id}") == F.col("n._target"), "left").select(
        f"c.{id}", F.coalesce(f"c.{key}", f"n.{key}").alias(key), *(F.coalesce(f"n.{x}", f"c.{x}").alias(x) for x in columns), *(f"c.{x}" for x in kept)
    )
    types = dict(current.dtypes)
    at = [] if first is None else [F.col("_pos").alias(first)]
    inserted = folded.where(F.col("_target").isNull()).select(
        F.lit(None).cast(types[id]).alias(id), key, *columns, *((F.lit("discovered") if x == "status" else F.lit(None).cast(types[x])).alias(x) for x in kept), *at
    )
    return updated.unionByName(inserted, allowMissingColumns=True).select(*current.columns, *([] if first is None else [first]))


def guarded_status(status: Column, wanted: Column) -> Column:
    """The wanted status, which rows beyond ranked do not take."""
    return F.when(status.isin(*OPEN) & wanted.isNotNull(), wanted).otherwise(status)


def fold_actions(jobs: DataFrame, actions: DataFrame) -> DataFrame:
    """Statuses after a log of actions (id, at, action). apply and reject always take effect, rank only on open rows."""
    target = F.when(F.col("action") == "apply", "applied").when(F.col("action").isin("reject", "close"), "closed")
    hard = actions.where(target.isNotNull()).groupBy("id").agg(F.max_by(target, "at").alias("hard"), F.max(F.when(F.col("action") == "apply", F.col("at"))).alias("applied_on"))
    soft = actions.where(F.col("action") == "rank").select("id", F.lit("ranked").alias("soft")).distinct()
    both = jobs.join(hard, "id", "left").join(soft, "id", "left")
    status = F.coalesce("hard", guarded_status(F.col("status"), F.col("soft")))
    return both.withColumn("status", status).withColumn("applied_at", F.coalesce("applied_on", "applied_at")).drop("hard", "soft", "applied_on")


def replace_latest(current: DataFrame, new: DataFrame, key: list[str], at: str) -> DataFrame:
    """The last written row of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc(at), F.desc("_new"))
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n", "_new")


def touch_sessions(touches: DataFrame, key: str = "session_id", at: str = "at", tie: str = "pos") -> DataFrame:
    """One row a session: identity as first given, when it began and when it was last active."""
    fixed = [c for c in touches.columns if c not in (key, at, tie)]
    order = F.struct(at, tie)
    first = [F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(at), F.col(tie), F.col(c).alias("v"))))["v"].alias(c) for c in fixed]
    return touches.groupBy(key).agg(*first, F.min(order)[at].alias("started_at"), F.max(order)[at].alias("last_active_at"))


def sync_codes(current: DataFrame, listed: DataFrame) -> DataFrame:
    """Codes after a file was read: those it lists are taken over, those from a file that it no longer lists are revoked."""
    c, f = current.alias("c"), listed.alias("f")
    both = c.join(f, F.col("c.code") == F.col("f.code"), "full")
    here = F.col("f.code").isNotNull()
    gone = (F.col("c.source") == "file") & ~here
    return both.select(
        F.coalesce("f.code", "c.code").alias("code"), F.when(here, F.col("f.label")).otherwise(F.col("c.label")).alias("label"), F.when(here, F.col("f.expires")).otherwise(F.col("c.expires")).alias("expires"),
        F.when(here, F.col("f.revoked")).when(gone, F.lit(1)).otherwise(F.col("c.revoked")).cast("int").alias("revoked"), F.when(here, F.lit("file")).otherwise(F.col("c.source")).alias("source"),
        F.coalesce("c.created_at", "f.created_at").alias("created_at"),
    )


def put_codes(current: DataFrame, new: DataFrame) -> DataFrame:
    """Codes after some were put in by hand (code, label, expires, url_auth, note, created_at): each replaces what there was, as live and by hand."""
    fresh = new.select("code", "label", "expires", "url_auth", F.lit(0).alias("revoked"), "note", F.lit("cli").alias("source"), "created_at")
    return current.join(new.select("code"), "code", "left_anti").select(current.columns).unionByName(fresh.select(current.columns))


def revoke_codes(current: DataFrame, codes: DataFrame) -> DataFrame:
    """Codes after some were revoked; those that a file lists don't take it."""
    named = codes.select("code", F.lit(True).alias("_named")).distinct()
    gone = F.coalesce(F.col("_named"), F.lit(False)) & (F.col("source") == "cli")
    return current.join(named, "code", "left").withColumn("revoked", F.when(gone, F.lit(1)).otherwise(F.col("revoked"))).select(current.columns)


def exchanges(log: DataFrame) -> DataFrame:
    """Two messages of each exchange; missing usage is 0."""
    usage = ["input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens"]
    zero = [F.lit(0).cast("long").alias(c) for c in usage]
    own = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in usage]
    asked = F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), *zero, F.lit(0.0).alias("cost_usd"))
    answered = F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"), *own, F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"))
    return log.select("session_id", "at", F.posexplode(F.array(asked, answered)).alias("part", "m")).select("session_id", "at", "part", "m.*")


def touched_by(sessions: DataFrame, log: DataFrame) -> DataFrame:
    """Sessions (session_id, last_active_at, ...) after the exchanges of a log (session_id, at)."""
    last = log.groupBy("session_id").agg(F.max("at").alias("_at"))
    return sessions.join(last, "session_id", "left").withColumn("last_active_at", F.greatest("last_active_at", "_at")).select(sessions.columns)


def delete(jobs: DataFrame, outcomes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the ids."""
    return jobs.join(ids, "id", "left_anti"), outcomes.join(ids.withColumnRenamed("id", "job_id"), "job_id", "left_anti")


def merge_collisions(jobs: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """One row a key: the only one that carries workflow state, else the oldest. Keys with several such rows, and rows without a key, stay.

    What a key keeps is found by sums, not by a window, so a key on very many rows is no hot group.
    """
    state = F.col("status").isin(*STATEFUL)
    best = jobs.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(state.cast("long")).alias("_states"), F.min(F.struct((~state).alias("s"), F.col("id").alias("id")))["id"].alias("_best"))
    marked = jobs.join(best, key, "left")
    return marked.where(F.col(key).isNull() | (F.col("_states") > 1) | (F.col("id") == F.col("_best"))).select(jobs.columns)


def update_targets(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Changed columns of config rows; a deny list comes as lines of text."""
    lines = F.filter(F.transform(F.split("deny_lines", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    ch = changes.withColumn("deny_list", F.when(F.col("deny_lines").isNotNull(), F.to_json(lines))).drop("deny_lines").alias("n")
    columns = [c for c in current.columns if c != "id"]
    n = ch.columns
    return current.alias("c").join(ch, F.col("c.id") == F.col("n.id"), "left").select("c.id", *(F.coalesce(f"n.{x}", f"c.{x}").alias(x) if x in n else F.col(f"c.{x}") for x in columns))


def backfill_titles(jobs: DataFrame, fetched: DataFrame) -> DataFrame:
    """Titles replaced by fetched ones that differ."""
    t = fetched.select("id", F.col("title").alias("_title"))
    return jobs.join(t, "id", "left").withColumn("title_changed", F.coalesce(F.col("_title") != F.coalesce("title", F.lit("")), F.lit(False))).withColumn("title", F.coalesce("_title", "title")).drop("_title")
