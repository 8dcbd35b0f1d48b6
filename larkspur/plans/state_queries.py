"""Queries over what is kept between runs: stored versions, seen keys, streams that decide, gated answers, long lists of phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import answers, phrases, views, windows
from larkspur.session import prepare, table, temporary
from larkspur.sources.store import Store, migrate, upsert
from larkspur.streaming import limits, replay, seen

from .data import RANK_SQL, as_of, jobs, outcomes
from .queries import WITH, _new_rows, query


def _folder(spark, name):
    return temporary(prepare(spark), name)


def _upserted(now: str, fresh: str, out: str) -> str:
    """The table after rows were written into it one by one, with the next ids for those that met none."""
    return f"""met_{out} AS (SELECT f.*, least((SELECT min(id) FROM {now} j WHERE j.dedupe_key = f.dedupe_key), (SELECT min(id) FROM {now} j WHERE j.url = f.url)) AS target FROM {fresh} f),
 folded_{out} AS (SELECT coalesce('i' || CAST(target AS VARCHAR), 'k' || dedupe_key, 'u' || url) AS place, any_value(target) AS target, min(pos) AS first, arg_max(dedupe_key, pos) FILTER (dedupe_key IS NOT NULL) AS dedupe_key, arg_max(url, pos) AS url,
  arg_max(company, pos) FILTER (company IS NOT NULL) AS company, arg_max(fit_score, pos) FILTER (fit_score IS NOT NULL) AS fit_score FROM met_{out} GROUP BY place),
 {out} AS (SELECT j.id, coalesce(j.dedupe_key, f.dedupe_key) AS dedupe_key, coalesce(f.url, j.url) AS url, coalesce(f.company, j.company) AS company, coalesce(f.fit_score, j.fit_score) AS fit_score, status FROM {now} j LEFT JOIN folded_{out} f ON f.target = j.id
  UNION ALL SELECT (SELECT max(id) FROM {now}) + row_number() OVER (ORDER BY first), dedupe_key, url, company, fit_score, 'discovered' FROM folded_{out} WHERE target IS NULL)"""


_FRESH = """fresh AS (SELECT CASE WHEN id % 8 = 0 THEN 'new' || CAST(id % 50 AS VARCHAR) WHEN id % 8 <> 1 THEN dedupe_key END AS dedupe_key, CASE WHEN id % 16 = 1 THEN 'https://new.example.com/' || CAST(id % 60 AS VARCHAR) ELSE url END AS url,
  CASE WHEN id % 3 <> 0 THEN 'New ' || CAST(id AS VARCHAR) END AS company, CASE WHEN id % 5 <> 0 THEN fit_score / 2 END AS fit_score, id AS pos FROM jobs)"""


@query(f"""{WITH}, {_FRESH}, stored AS (SELECT id, dedupe_key, url, company, fit_score, status FROM jobs WHERE id % 4 <> 3), one AS (SELECT * FROM fresh WHERE pos % 2 = 0), two AS (SELECT * FROM fresh WHERE pos % 2 = 1),
 {_upserted('stored', 'one', 'second')}, {_upserted('second', 'two', 'third')} SELECT id, dedupe_key, url, company, fit_score, status FROM third""")
def m1_stored_upserts(spark, d):
    """Two upserts in a row over a store, each from the version that the one before published."""
    store = Store(prepare(spark), _folder(spark, "jobs"))
    first = jobs(spark, d).where(F.col("id") % 4 != 3).select("id", "dedupe_key", "url", "company", "fit_score", "status")
    store.write(first, last_id=first.agg(F.max("id")).first()[0] or 0)
    new = _new_rows(spark, d)
    for part in (0, 1):
        upsert(store, new.where(F.col("pos") % 2 == part), kept=("status",))
    return store.read()


_STALE = """stale AS (SELECT *, CASE k WHEN 0 THEN 'https://boards.greenhouse.io/acme/jobs/' || n || '?utm_source=x' WHEN 1 THEN 'https://www.linkedin.com/jobs/view/' || n || '/' WHEN 2 THEN 'https://jobs.lever.co/acme/' || lpad(CAST(n AS VARCHAR), 8, '0') || '-0000-0000-0000-000000000000' END AS url,
  CASE k WHEN 0 THEN 'gh:' || n WHEN 1 THEN 'linkedin:' || n WHEN 2 THEN 'lever:' || lpad(CAST(n AS VARCHAR), 8, '0') ELSE 'kept' || n END AS key FROM (SELECT id, status, id % 4 AS k, id // 4 % 60 AS n FROM jobs))"""


@query(f"""{WITH}, {_STALE}, ruled AS (SELECT *, sum(CASE WHEN status IN ('applied', 'closed') THEN 1 ELSE 0 END) OVER w AS states, first_value(id) OVER (PARTITION BY key ORDER BY CASE WHEN status IN ('applied', 'closed') THEN 0 ELSE 1 END, id) AS best FROM stale WINDOW w AS (PARTITION BY key))
 SELECT id, url, key AS dedupe_key, status, 'ashby' AS ats_platform FROM ruled WHERE states > 1 OR id = best""")
def m10_migrated(spark, d):
    """Jobs of which half have keys of an older rule, stored and migrated twice; the second time changes nothing."""
    n, k = F.floor(F.col("id") / 4) % 60, F.col("id") % 4
    eight = F.lpad(n.cast("string"), 8, "0")
    url = F.when(k == 0, F.concat(F.lit("https://boards.greenhouse.io/acme/jobs/"), n.cast("string"), F.lit("?utm_source=x"))).when(k == 1, F.concat(F.lit("https://www.linkedin.com/jobs/view/"), n.cast("string"), F.lit("/"))).when(k == 2, F.concat(F.lit("https://jobs.lever.co/acme/"), eight, F.lit("-0000-0000-0000-000000000000")))
    new = F.when(k == 0, F.concat(F.lit("gh:"), n.cast("string"))).when(k == 1, F.concat(F.lit("linkedin:"), n.cast("string"))).when(k == 2, F.concat(F.lit("lever:"), eight)).otherwise(F.concat(F.lit("kept"), n.cast("string")))
    rows = jobs(spark, d).select("id", url.alias("url"), F.when((F.col("id") % 2 == 0) & (k != 3) & (F.col("id") % 8 < 4), url).otherwise(new).alias("dedupe_key"), "status", F.lit("AshbyHQ").alias("ats_platform"))
    store = Store(prepare(spark), _folder(spark, "migrated"))
    store.write(rows)
    done = migrate(store)
    if migrate(store).number != done.number:
        raise AssertionError("a second migration changed the store")
    return store.read()


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def t7_seen_across_runs(spark, d):
    """First sightings of users over micro-batches in two runs of a stream, one batch being replayed behind each."""
    events = table(prepare(spark), d, "events").select("event_id", "ts", "user_id", "event_type")
    folder = _folder(spark, "seen")
    store = Store(spark, f"{folder}/store")
    middle = events.agg(F.percentile_approx(F.unix_micros(F.col("ts")), 0.5)).first()[0]
    for part in (events.where(F.unix_micros("ts") <= middle), events.where(F.unix_micros("ts") > middle)):
        stream = replay.in_order(part, "ts", 2, f"{folder}/events")
        seen.carried(stream, store, f"{folder}/checkpoint", key="user_id", order=["ts", "event_id"])
        last = store.latest()
        seen.SeenSink(store, "user_id", ["ts", "event_id"])(part.limit(50), last.marks["batch:seen"])
        if store.latest().number != last.number:
            raise AssertionError("a replayed batch changed the store")
    return store.read().select("user_id", "event_id", "event_type")


@query("SELECT user_id, event_id, CAST(n AS DOUBLE) AS value, n <= 3 AS within FROM (SELECT *, count(*) OVER (PARTITION BY user_id, floor(epoch(ts) / 3600) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events)")
def t1_stream_limit(spark, d):
    """Each event's running count of the hour and verdict, told by a stream."""
    limits.stateful(prepare(spark))
    events = table(spark, d, "events").select("event_id", "ts", "user_id")
    return replay.result(limits.decided(replay.in_order(events, "ts", 3), "user_id", F.lit(1), limit=3, size=windows.HOUR))


@query("SELECT user_id, event_id, coalesce(sum(cost) OVER (PARTITION BY user_id, floor(epoch(ts) / 86400) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS value, coalesce(sum(cost) OVER (PARTITION BY user_id, floor(epoch(ts) / 86400) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 1 AS within FROM (SELECT *, CAST(event_id % 4 AS DOUBLE) / 4 AS cost FROM events)")
def t2_stream_budget(spark, d):
    """What each event's user had spent in the day, told by a stream."""
    limits.stateful(prepare(spark))
    events = table(spark, d, "events").select("event_id", "ts", "user_id")
    return replay.result(limits.decided(replay.in_order(events, "ts", 3), "user_id", (F.col("event_id") % 4).cast("double") / 4, limit=1, size=windows.DAY, before=True))


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) > 43200 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g), p AS (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY ts, event_id) AS place FROM s)
 SELECT user_id, event_id, CAST(floor(epoch(min(ts) OVER (PARTITION BY user_id, k))) AS BIGINT) AS started, place, place <= 2 AS within FROM p""")
def t4_stream_sessions(spark, d):
    """Each event's place in its session, which ends after twelve idle hours, and whether that is within a cap, told by a stream."""
    limits.stateful(prepare(spark))
    events = table(spark, d, "events").select("event_id", "ts", "user_id")
    return replay.result(limits.sessions(replay.in_order(events, "ts", 3), "user_id", most=2))


def questions(spark, d):
    """What people asked in conversations: seven codes, one of them asking a third; a few seconds apart."""
    code = F.when(F.col("conv_id") % 3 == 0, F.lit("c0")).otherwise(F.concat(F.lit("c"), (F.col("conv_id") % 7).cast("string")))
    asked = table(prepare(spark), d, "conversations").where(F.col("role") == "user")
    second = F.col("turn") * 900 + F.col("conv_id") * 7
    return asked.select(code.alias("code"), (F.col("conv_id") % 40).alias("session_id"), F.timestamp_seconds(second).alias("at"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), (F.length("text") % 90 / 100.0).cast("double").alias("cost_usd"))


@query()
def d15_gated_answers(spark, d):
    return answers.gated(questions(spark, d), turns=8, requests=20, dollars=5.0, dollars_all=25.0).select("pos", "code", "session_id", "outcome")


_WORDS = "string_split(lower(text), ' ')"


@query(f"""WITH listed AS (SELECT doc_id AS pos, {_WORDS}[3] || ' ' || {_WORDS}[4] AS phrase FROM documents), texts AS (SELECT doc_id, lower(text) AS low FROM documents)
 SELECT doc_id, arg_min(phrase, pos) AS phrase FROM texts LEFT JOIN (SELECT phrase, min(pos) AS pos FROM listed WHERE phrase IS NOT NULL GROUP BY phrase) l ON contains(low, phrase) GROUP BY doc_id""")
def f1_many_phrases(spark, d):
    """The first of as many phrases as there are documents, two words of each, that a document holds."""
    documents = table(prepare(spark), d, "documents").select("doc_id", "text")
    words = F.split(F.lower("text"), " ")
    listed = documents.select(F.col("doc_id").alias("pos"), F.concat(F.get(words, 2), F.lit(" "), F.get(words, 3)).alias("phrase"))
    return phrases.match(documents, listed, text="text").select("doc_id", "phrase")



@query(f"""{RANK_SQL} SELECT id, floor(live_rank * 100 + 0.5) / 100 AS rank, CASE WHEN id % 4 = 0 THEN 'own' WHEN fit_score IS NULL THEN NULL WHEN fit_score >= 80 THEN 'strong_match' WHEN fit_score >= 60 THEN 'consider' WHEN fit_score >= 40 THEN 'weak_match' ELSE 'skip' END AS recommendation,
 CASE WHEN id % 3 = 0 THEN 'new' || id WHEN id % 3 = 1 THEN 'old' || id ELSE '' END AS summary, CASE WHEN id % 3 = 2 THEN 0 ELSE 2 END AS n_strengths FROM ranked""")
def p4_decorated(spark, d):
    """Jobs with their analyses, under newer names, older ones, or malformed."""
    i = F.col("id")
    text = lambda prefix: F.concat(F.lit(prefix), i.cast("string"))
    listed = F.array(F.lit("a"), F.lit("b"))
    own = F.when(i % 4 == 0, F.lit("own"))
    newer = F.to_json(F.struct(text("new").alias("candidate_explanation"), listed.alias("candidate_strengths"), own.alias("recommendation")))
    older = F.to_json(F.struct(text("old").alias("summary"), listed.alias("strengths"), own.alias("recommendation")))
    given = jobs(spark, d).withColumn("analysis_json", F.when(i % 3 == 0, newer).when(i % 3 == 1, older).when(i % 4 == 0, F.lit('{"recommendation": "own"}')).when(i % 2 == 0, F.lit("broken")))
    shown = views.decorated(given, outcomes(spark, d), as_of())
    return shown.select("id", "rank", "recommendation", "summary", F.size("strengths").alias("n_strengths"))
