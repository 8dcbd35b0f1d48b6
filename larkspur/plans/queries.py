"""Queries over the driver's tables, one or more for each operator, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import dates, ranking, rows, text, urls
from larkspur.operators import dedupe, filters, merge, order, screening, stats, views, windows
from larkspur.session import prepare, table

from .data import AS_OF, JOBS, MESSAGES, OUTCOMES, RANK_SQL, STATS, _day, as_of, jobs, messages, outcomes, unescaped_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
WITH = f"WITH {JOBS}, {OUTCOMES}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _values(spark: SparkSession, schema: str, data: list[tuple]) -> DataFrame:
    return prepare(spark).createDataFrame(data, schema)


def _literals(data: list[tuple], columns: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + x.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in data)}) AS t({columns})"


# Scans and lookups


@query(f"{WITH} SELECT id, status, ats_platform, fit_score, callback, rejected, offer FROM jobs LEFT JOIN outcomes ON id = job_id WHERE status IN ('discovered', 'ranked')")
def s1_jobs_with_outcomes(spark, d):
    return jobs(spark, d).where(F.col("status").isin("discovered", "ranked")).join(outcomes(spark, d), F.col("id") == F.col("job_id"), "left").select("id", "status", "ats_platform", "fit_score", "callback", "rejected", "offer")


@query(f"{WITH} SELECT id, company, status, callback FROM jobs LEFT JOIN outcomes ON id = job_id WHERE id = 42")
def s2_point_lookup(spark, d):
    return jobs(spark, d).where(F.col("id") == 42).join(outcomes(spark, d), F.col("id") == F.col("job_id"), "left").select("id", "company", "status", "callback")


@query(f"{WITH} SELECT id, dedupe_key, url FROM jobs WHERE dedupe_key = 'k7' OR url = 'https://jobs.example.com/src3/3' ORDER BY (dedupe_key = 'k7') DESC, id LIMIT 1")
def s3_lookup_by_key_or_url(spark, d):
    hit = F.col("dedupe_key") == "k7"
    return jobs(spark, d).where(hit | (F.col("url") == "https://jobs.example.com/src3/3")).orderBy(hit.desc(), "id").limit(1).select("id", "dedupe_key", "url")


@query(f"{WITH} SELECT DISTINCT dedupe_key FROM jobs WHERE dedupe_key IS NOT NULL")
def s4_seen_keys(spark, d):
    return jobs(spark, d).where(F.col("dedupe_key").isNotNull()).select("dedupe_key").distinct()


@query(f"{WITH} SELECT id, fit_score, desirability_score, posted_at, ats_platform FROM jobs WHERE fit_score IS NOT NULL")
def s5_rerank_scan(spark, d):
    return jobs(spark, d).where(F.col("fit_score").isNotNull()).select("id", "fit_score", "desirability_score", "posted_at", "ats_platform")


@query("SELECT s_suppkey AS id, s_name AS name, row_number() OVER (ORDER BY lower(s_name), s_suppkey) AS place FROM supplier")
def s6_targets_by_name(spark, d):
    return order.numbered(table(prepare(spark), d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), F.lower("name"), F.col("id"))


# Aggregates


@query(f"{WITH} SELECT status, count(*) AS n FROM jobs GROUP BY status")
def a1_status_counts(spark, d):
    return stats.status_counts(jobs(spark, d))


@query(f"{WITH} SELECT CAST(sum(CASE WHEN status IN ('discovered', 'ranked') THEN 1 ELSE 0 END) AS BIGINT) AS n_open, CAST(sum(CASE WHEN status = 'applied' THEN 1 ELSE 0 END) AS BIGINT) AS n_applied, CAST(sum(CASE WHEN status = 'closed' THEN 1 ELSE 0 END) AS BIGINT) AS n_closed, count(*) AS n_total FROM jobs")
def a1_status_summary(spark, d):
    return stats.status_summary(jobs(spark, d))


@query(f"{WITH}, {STATS} SELECT ats_platform, callbacks, applied FROM per")
def a2_platform_stats(spark, d):
    return stats.platform_stats(jobs(spark, d), outcomes(spark, d))


@query(f"{WITH}, {STATS} SELECT global_rate, global_applied FROM total")
def a2_global_stats(spark, d):
    return stats.global_stats(jobs(spark, d), outcomes(spark, d))


@query(f"{WITH}, {STATS} SELECT count(*) AS applied, CAST(coalesce(sum(callback), 0) AS BIGINT) AS callbacks, CAST(coalesce(sum(offer), 0) AS BIGINT) AS offers, floor(coalesce(sum(callback) * 100.0::DOUBLE / nullif(count(*), 0), 0.0) * 10 + 0.5) / 10 AS rate_percent FROM applied")
def a3_banner(spark, d):
    return stats.banner(jobs(spark, d), outcomes(spark, d))


_USAGE = f"""WITH {MESSAGES}, sess AS (SELECT session_id, 'code' || CAST(session_id % 7 AS VARCHAR) AS code, max(turn) AS last_active_at FROM messages GROUP BY session_id),
 per AS (SELECT session_id, count(*) AS n, sum(output_tokens) AS tokens FROM messages GROUP BY session_id)"""


@query(f"{_USAGE} SELECT code, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_messages, CAST(sum(tokens) AS DOUBLE) AS cost_usd, max(last_active_at) AS last_active_at FROM sess JOIN per USING (session_id) GROUP BY code")
def a4_usage_summary(spark, d):
    m = messages(spark, d).withColumn("cost_usd", F.col("output_tokens").cast("double"))
    s = m.groupBy("session_id").agg(F.max("turn").alias("last_active_at")).withColumn("code", F.concat(F.lit("code"), (F.col("session_id") % 7).cast("string")))
    return windows.usage_summary(s.select("code").distinct(), s, m)


@query(f"{WITH} SELECT dedupe_key, count(*) AS n FROM jobs WHERE dedupe_key IS NOT NULL GROUP BY dedupe_key HAVING count(*) > 1")
def a5_duplicate_keys(spark, d):
    return stats.duplicate_keys(jobs(spark, d))


@query(f"{WITH} SELECT company, count(*) AS n FROM jobs GROUP BY company ORDER BY n DESC, min(id) LIMIT 12")
def a8_most_common(spark, d):
    return stats.most_common(jobs(spark, d), "company", "id", 12)


_POSITIONS = " UNION ALL ".join(
    f"SELECT '{n}' AS formula, count(*) AS n_applied, CAST(coalesce(sum(CASE WHEN desirability_score IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_pending, CAST(coalesce(sum(CASE WHEN position <= 5 THEN 1 ELSE 0 END), 0) AS BIGINT) AS hits, min(position) AS best FROM (SELECT a.id, a.desirability_score, CASE WHEN a.{c} IS NOT NULL THEN 1 + (SELECT count(*) FROM ranked b WHERE b.status IN ('discovered', 'ranked') AND (b.{c} > a.{c} OR (b.{c} = a.{c} AND b.fit_score > a.fit_score))) END AS position FROM ranked a WHERE a.status = 'applied')"
    for n, c in (("current", "live_rank"), ("legacy", "legacy"))
)


@query(f"{RANK_SQL} {_POSITIONS}")
def a9_backtest(spark, d):
    return views.backtest(jobs(spark, d), outcomes(spark, d), as_of())


@query("SELECT lang, CAST(floor(sum(length(text)) / 4.0) AS BIGINT) AS n_tokens, sum(length(text)) / 4.0 > 150000 AS too_long FROM documents GROUP BY lang")
def a10_token_estimate(spark, d):
    n = F.sum(F.length("text"))
    return table(prepare(spark), d, "documents").groupBy("lang").agg(F.floor(n / 4).alias("n_tokens"), (n / 4 > 150_000).alias("too_long"))


@query("SELECT conv_id, md5(string_agg('## ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS assembled_md5 FROM conversations GROUP BY conv_id")
def a11_assembly(spark, d):
    part = F.struct("turn", F.concat(F.lit("## "), F.col("role"), F.lit("\n"), F.col("text")).alias("doc"))
    docs = F.transform(F.sort_array(F.collect_list(part)), lambda x: x["doc"])
    return table(prepare(spark), d, "conversations").groupBy("conv_id").agg(F.md5(F.encode(F.array_join(docs, "\n\n"), "utf-8")).alias("assembled_md5"))


# Ranking and views


@query(f"{RANK_SQL} SELECT id, floor(live_rank * 100 + 0.5) / 100 AS rank FROM ranked")
def r1_rank_score(spark, d):
    return views.live_rank(jobs(spark, d), outcomes(spark, d), as_of()).select("id", ranking.shown(F.col("live_rank")).alias("rank"))


@query(f"{RANK_SQL} SELECT id, floor(decay * 10000 + 0.5) / 10000 AS decay, floor(factor * 10000 + 0.5) / 10000 AS factor FROM ranked")
def r2_r3_decay_and_factor(spark, d):
    given = F.coalesce(F.nullif("posted_at", F.lit("")), "discovered_at")
    factor = F.when(F.col("global_applied") >= ranking.MIN_APPLIED, ranking.platform_factor(F.col("callbacks"), F.col("applied"), F.col("global_rate"))).otherwise(F.lit(1.0))
    four = lambda x: F.floor(x * 10000 + 0.5) / 10000
    return views.with_stats(jobs(spark, d), outcomes(spark, d)).select("id", four(ranking.age_decay(dates.iso_date(given), as_of())).alias("decay"), four(factor).alias("factor"))


@query(f"{RANK_SQL} SELECT id, floor(legacy * 100 + 0.5) / 100 AS rank FROM ranked")
def r5_legacy_score(spark, d):
    s = {c: F.col(c) for c in ("callbacks", "applied", "global_rate", "global_applied")}
    cols = [F.col(c) for c in ("fit_score", "desirability_score", "posted_at", "discovered_at")]
    return views.with_stats(jobs(spark, d), outcomes(spark, d)).select("id", ranking.shown(ranking.legacy_score(*cols, as_of(), **s)).alias("rank"))


@query(f"{WITH} SELECT id, CAST({_day('posted_at')} AS VARCHAR) AS day FROM jobs")
def r6_tolerant_date(spark, d):
    return jobs(spark, d).select("id", dates.iso_date(F.col("posted_at")).cast("string").alias("day"))


_ADJUST = [(1, "company 1", -30.0), (2, "Company 5", 10.0), (3, "company 9", 5.0), (4, "", 99.0)]


@query(f"{WITH}, adj AS (SELECT pos, lower(name) AS name, CAST(points AS DOUBLE) AS points FROM {_literals(_ADJUST, 'pos, name, points')}) SELECT id, coalesce((SELECT points FROM adj WHERE name = lower(company) ORDER BY pos LIMIT 1), (SELECT points FROM adj WHERE name <> '' AND contains(lower(company), name) ORDER BY pos LIMIT 1), 0.0) AS adjustment FROM jobs")
def j7_company_adjustment(spark, d):
    return views.company_adjustment(jobs(spark, d), _values(spark, "pos int, name string, points double", _ADJUST)).select("id", "adjustment")


@query(f"{RANK_SQL} SELECT id, status, ats_platform, fit_score, desirability_score, floor(live_rank * 100 + 0.5) / 100 AS rank, CASE WHEN fit_score >= 80 THEN 'strong_match' WHEN fit_score >= 60 THEN 'consider' WHEN fit_score >= 40 THEN 'weak_match' ELSE 'skip' END AS recommendation, CASE WHEN days IS NULL THEN '—' ELSE (CASE WHEN posted_at IS NULL THEN 'discovered ' ELSE 'posted ' END) || (CASE WHEN days <= 0 THEN 'today' WHEN days = 1 THEN '1 day ago' WHEN days < 30 THEN CAST(days AS VARCHAR) || ' days ago' WHEN days < 90 THEN CAST(days // 7 AS VARCHAR) || 'w ago' ELSE CAST(days // 30 AS VARCHAR) || 'mo ago' END) END AS age FROM ranked WHERE status IN ('discovered', 'ranked')")
def d9_inbox(spark, d):
    return views.inbox(jobs(spark, d), outcomes(spark, d), as_of())


@query(f"{RANK_SQL} SELECT id, floor(live_rank * 100 + 0.5) / 100 AS rank FROM ranked WHERE status IN ('discovered', 'ranked') AND fit_score > 70 AND live_rank > 60")
def f12_high_priority(spark, d):
    return views.high_priority(jobs(spark, d), outcomes(spark, d), as_of(), 70, 60).select("id", ranking.shown(F.col("live_rank")).alias("rank"))


@query(f"{RANK_SQL} SELECT id, status, row_number() OVER (ORDER BY coalesce(live_rank, -1) DESC, fit_score DESC, id DESC) AS place FROM ranked ORDER BY place LIMIT 50")
def o1_top_of_board(spark, d):
    ranked = views.live_rank(jobs(spark, d), outcomes(spark, d), as_of())
    return order.first_places(ranked, 50, F.desc(F.coalesce("live_rank", F.lit(-1.0))), F.desc("fit_score"), F.desc("id")).select("id", "status", "place")


# Filters

_DENY = ["Manager", "sales", "haedan", "thethe", "the on"]


@query(f"{WITH} SELECT id, CASE " + " ".join(f"WHEN contains(lower(title), '{p.lower()}') THEN '{p}'" for p in _DENY) + " END AS phrase FROM jobs")
def f1_denied_phrase(spark, d):
    return jobs(spark, d).select("id", filters.denied_phrase(F.col("title"), F.array(*map(F.lit, _DENY))).alias("phrase"))


@query("SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'no title' ELSE coalesce(nullif(regexp_extract(lower(text), '\\b(intern|internship|apprentice|new[- ]grad)\\b', 1), ''), nullif(regexp_extract(lower(text), '(?:^|[^\\p{L}\\p{N}_])(the|und)(?:$|[^\\p{L}\\p{N}_])', 1), '')) END AS word, coalesce(length(text) >= 100, false) AS long_enough FROM documents")
def f5_f6_title_rules(spark, d):
    docs = table(prepare(spark), d, "documents")
    return docs.select("doc_id", filters.title_drop(F.col("text"), ["the", "und"]).alias("word"), filters.long_enough(F.col("text")).alias("long_enough"))


_IDLE = "coalesce(referral, 0) = 0 AND coalesce(callback, 0) = 0 AND coalesce(ghosted, 0) = 0 AND coalesce(rejected, 0) = 0 AND coalesce(offer, 0) = 0 AND coalesce(trim(notes), '') = ''"
_CANDIDATES = f"candidates AS (SELECT jobs.* FROM jobs LEFT JOIN outcomes ON id = job_id WHERE status IN ('discovered', 'ranked') AND {_IDLE})"


@query(f"{WITH}, {_CANDIDATES} SELECT id, status FROM candidates")
def f8_cleanup_candidates(spark, d):
    return filters.cleanup_candidates(jobs(spark, d), outcomes(spark, d)).select("id", "status")


@query(f"{WITH}, {_CANDIDATES} SELECT id, CASE WHEN CAST(discovered_at AS DATE) < DATE '{AS_OF}' - 35 THEN 'age' ELSE 'dead' END AS reason FROM candidates WHERE CAST(discovered_at AS DATE) < DATE '{AS_OF}' - 35 OR id % 6 = 0")
def f9_d11_cleanup(spark, d):
    dead = jobs(spark, d).where(F.col("id") % 6 == 0).select("id")
    return filters.cleanup_decision(filters.cleanup_candidates(jobs(spark, d), outcomes(spark, d)), dead, as_of()).select("id", "reason")


@query(f"{WITH} SELECT id, fit_score FROM jobs WHERE status IN ('discovered', 'ranked') AND fit_score IS NOT NULL AND desirability_score IS NULL ORDER BY fit_score DESC, id LIMIT 30")
def f11_o6_missing_enrichment(spark, d):
    missing = jobs(spark, d).where(F.col("status").isin("discovered", "ranked") & F.col("fit_score").isNotNull() & F.col("desirability_score").isNull())
    return missing.orderBy(F.desc_nulls_last("fit_score"), "id").limit(30).select("id", "fit_score")


@query("SELECT page_id, url LIKE 'http://%' OR url LIKE 'https://%' AS scoreable, regexp_matches(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '/(careers|jobs|open-positions|openings|positions|join(-us)?|work-with-us|hiring|we-are-hiring)/?$') AS careers_index FROM pages")
def f13_url_predicates(spark, d):
    return table(prepare(spark), d, "pages").select("page_id", urls.is_scoreable(F.col("url")).alias("scoreable"), urls.is_careers_index(F.col("url")).alias("careers_index"))


_NEEDLES = [(1, "Secret"), (2, "token"), (3, "AKIA")]


@query("WITH lines AS (SELECT CAST(doc_id AS VARCHAR) AS path, unnest(range(len(string_split(text, chr(10))))) + 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT path, line_no, CASE WHEN contains(lower(line), 'secret') THEN 'secret' WHEN contains(lower(line), 'token') THEN 'token' ELSE 'akia' END AS needle FROM lines WHERE regexp_matches(lower(line), 'secret|token|akia') ORDER BY path, line_no LIMIT 1")
def f16_lint(spark, d):
    lines = table(prepare(spark), d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.posexplode(F.split("text", "\n")).alias("p", "line")).select("path", (F.col("p") + 1).cast("long").alias("line_no"), "line")
    return filters.lint(lines, _values(spark, "pos int, needle string", _NEEDLES))


# Dedupe and merge


@query(f"{WITH} SELECT dedupe_key, min(id) AS id FROM jobs GROUP BY dedupe_key")
def o9_first_per_key(spark, d):
    return dedupe.first_per_key(jobs(spark, d).select("dedupe_key", "id"), "dedupe_key", "id")


@query(f"{WITH} SELECT id FROM jobs WHERE dedupe_key NOT IN (SELECT dedupe_key FROM jobs WHERE status = 'applied')")
def j4_unseen(spark, d):
    j = jobs(spark, d)
    return dedupe.unseen(j, j.where(F.col("status") == "applied"), "dedupe_key").select("id")


_WATCHED = [(" company 3 ",), ("COMPANY 8",)]


@query(f"{WITH} SELECT id FROM jobs WHERE lower(company) NOT IN ('company 3', 'company 8')")
def j5_unwatched(spark, d):
    return dedupe.unwatched(jobs(spark, d), _values(spark, "company string", _WATCHED)).select("id")


_LABELLED = """marked AS (SELECT id, dedupe_key, dedupe_key IN (SELECT DISTINCT dedupe_key FROM jobs WHERE status = 'closed') AS seen, lower(company) IN ('company 3', 'company 8') AS watched FROM jobs),
 counted AS (SELECT *, coalesce(sum(CASE WHEN NOT seen AND NOT watched THEN 1 ELSE 0 END) OVER (PARTITION BY dedupe_key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM marked)"""


@query(f"{WITH}, {_LABELLED} SELECT id, CASE WHEN seen THEN 'seen' WHEN before > 0 THEN 'duplicate' WHEN watched THEN 'watched' ELSE 'fresh' END AS outcome FROM counted")
def d2_label_incoming(spark, d):
    j = jobs(spark, d)
    return dedupe.label_incoming(j, j.where(F.col("status") == "closed"), _values(spark, "company string", _WATCHED), pos="id").select("id", "outcome")


@query(f"{WITH} SELECT id, ats_platform FROM (SELECT id, ats_platform, row_number() OVER (PARTITION BY ats_platform ORDER BY id) AS n FROM jobs) WHERE n <= 5")
def o7_capped(spark, d):
    return dedupe.capped(jobs(spark, d), "ats_platform", "id", 5).select("id", "ats_platform")


_WALK = f"""WITH RECURSIVE {JOBS}, base AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ats_platform, id) AS k, id, dedupe_key, ats_platform, dedupe_key IN (SELECT dedupe_key FROM jobs WHERE status = 'closed') AS seen, contains(lower(title), 'thethe') AS denied, discovered_by = 'fr' AS region, length(description) < 400 AS short FROM jobs),
 state AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, '' AS ats_platform, 0 AS n, '' AS exit_reason, CAST([] AS VARCHAR[]) AS keys
  UNION ALL SELECT k, id, ats_platform, n + CASE WHEN reason = 'scored' THEN 1 ELSE 0 END, reason, CASE WHEN reason = 'scored' THEN list_append(keys, dedupe_key) ELSE keys END FROM (
   SELECT *, CASE WHEN stopped THEN 'unread' WHEN seen THEN 'seen' WHEN list_contains(keys, dedupe_key) THEN 'duplicate' WHEN denied THEN 'denied' WHEN region THEN 'region' WHEN n >= 6 THEN 'capped' WHEN short THEN 'short' ELSE 'scored' END AS reason FROM (
    SELECT b.*, s.keys, CASE WHEN b.ats_platform = s.ats_platform THEN s.n ELSE 0 END AS n, b.ats_platform = s.ats_platform AND s.exit_reason IN ('capped', 'unread') AS stopped FROM state s JOIN base b ON b.k = s.k + 1))),
 walked AS (SELECT id, ats_platform, exit_reason FROM state WHERE k > 0)"""


def _walked(spark, d):
    j = jobs(spark, d)
    return dedupe.poll(
        j, j.where(F.col("status") == "closed"), denied=F.contains(F.lower("title"), F.lit("thethe")), allowed=F.col("discovered_by") != "fr", long_enough=F.length("description") >= 400, max_new=6, target="ats_platform", pos="id",
    )


@query(f"{_WALK} SELECT id, exit_reason FROM walked")
def d1_poll_walk(spark, d):
    return _walked(spark, d).select("id", "exit_reason")


_N = lambda name, *r: f"CAST(sum(CASE WHEN exit_reason IN ({', '.join(repr(x) for x in r)}) THEN 1 ELSE 0 END) AS BIGINT) AS {name}"


@query(f"{_WALK} SELECT ats_platform, count(*) AS found, {_N('skipped_seen', 'seen', 'duplicate')}, {_N('denied', 'denied')}, {_N('out_of_region', 'region')}, {_N('too_short', 'short')}, {_N('capped', 'capped')}, {_N('scored', 'scored')} FROM walked GROUP BY ROLLUP (ats_platform)")
def a6_run_totals(spark, d):
    return stats.run_totals(_walked(spark, d), "ats_platform")


def _new_rows(spark, d):
    """A new row for each posting: some under a key that is unknown, some by their address only, some under neither."""
    i = F.col("id")
    return jobs(spark, d).select(
        F.when(i % 8 == 0, F.concat(F.lit("new"), (i % 50).cast("string"))).when(i % 8 != 1, F.col("dedupe_key")).alias("dedupe_key"),
        F.when(i % 16 == 1, F.concat(F.lit("https://new.example.com/"), (i % 60).cast("string"))).otherwise(F.col("url")).alias("url"),
        F.when(i % 3 != 0, F.concat(F.lit("New "), i.cast("string"))).alias("company"), F.when(i % 5 != 0, F.col("fit_score") / 2).alias("fit_score"), i.alias("pos"),
    )


_UPSERT = """fresh AS (SELECT CASE WHEN id % 8 = 0 THEN 'new' || CAST(id % 50 AS VARCHAR) WHEN id % 8 <> 1 THEN dedupe_key END AS dedupe_key, CASE WHEN id % 16 = 1 THEN 'https://new.example.com/' || CAST(id % 60 AS VARCHAR) ELSE url END AS url,
  CASE WHEN id % 3 <> 0 THEN 'New ' || CAST(id AS VARCHAR) END AS company, CASE WHEN id % 5 <> 0 THEN fit_score / 2 END AS fit_score, id AS pos FROM jobs),
 met AS (SELECT f.*, least((SELECT min(id) FROM jobs j WHERE j.dedupe_key = f.dedupe_key), (SELECT min(id) FROM jobs j WHERE j.url = f.url)) AS target FROM fresh f),
 folded AS (SELECT coalesce('i' || CAST(target AS VARCHAR), 'k' || dedupe_key, 'u' || url) AS place, any_value(target) AS target, arg_max(dedupe_key, pos) FILTER (dedupe_key IS NOT NULL) AS dedupe_key, arg_max(url, pos) AS url, arg_max(company, pos) FILTER (company IS NOT NULL) AS company, arg_max(fit_score, pos) FILTER (fit_score IS NOT NULL) AS fit_score FROM met GROUP BY place)"""


@query(f"{WITH}, {_UPSERT} SELECT j.id, coalesce(j.dedupe_key, f.dedupe_key) AS dedupe_key, coalesce(f.url, j.url) AS url, coalesce(f.company, j.company) AS company, coalesce(f.fit_score, j.fit_score) AS fit_score, status, applied_at FROM jobs j LEFT JOIN folded f ON f.target = j.id UNION ALL SELECT NULL, dedupe_key, url, company, fit_score, 'discovered', NULL FROM folded WHERE target IS NULL")
def m1_upsert(spark, d):
    current = jobs(spark, d).select("id", "dedupe_key", "url", "company", "fit_score", "status", "applied_at")
    return merge.upsert_jobs(current, _new_rows(spark, d), kept=("status", "applied_at"))


@query(f"{WITH} SELECT id, CASE WHEN status IN ('discovered', 'ranked') AND id % 2 = 0 THEN 'ranked' ELSE status END AS status FROM jobs")
def m2_guarded_status(spark, d):
    return jobs(spark, d).select("id", merge.guarded_status(F.col("status"), F.when(F.col("id") % 2 == 0, "ranked")).alias("status"))


_ACTIONS = "actions AS (SELECT user_id AS id, ts AS at, event_id, CASE event_id % 5 WHEN 0 THEN 'apply' WHEN 1 THEN 'reject' WHEN 2 THEN 'close' ELSE 'rank' END AS action FROM events)"


@query(f"{WITH}, {_ACTIONS}, hard AS (SELECT id, arg_max(CASE action WHEN 'apply' THEN 'applied' ELSE 'closed' END, event_id) AS hard FROM actions WHERE action <> 'rank' GROUP BY id), soft AS (SELECT DISTINCT id FROM actions WHERE action = 'rank') SELECT j.id, coalesce(h.hard, CASE WHEN j.status IN ('discovered', 'ranked') AND s.id IS NOT NULL THEN 'ranked' ELSE j.status END) AS status FROM jobs j LEFT JOIN hard h USING (id) LEFT JOIN soft s ON j.id = s.id")
def m3_fold_actions(spark, d):
    e = table(prepare(spark), d, "events")
    k = F.col("event_id") % 5
    actions = e.select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), F.when(k == 0, "apply").when(k == 1, "reject").when(k == 2, "close").otherwise("rank").alias("action"))
    return merge.fold_actions(jobs(spark, d).withColumn("applied_at", F.lit(None).cast("long")), actions).select("id", "status")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def m4_replace_latest(spark, d):
    e = table(prepare(spark), d, "events").select("user_id", "event_type", "event_id", "value")
    return merge.replace_latest(e.where(F.col("event_id") % 2 == 0), e.where(F.col("event_id") % 2 == 1), ["user_id"], "event_id")


@query("SELECT user_id, min(event_id) AS started_at, max(event_id) AS last_active_at, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def m5_touch_sessions(spark, d):
    e = table(prepare(spark), d, "events").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("pos"), "event_type")
    return merge.touch_sessions(e, key="user_id")


@query("SELECT q.conv_id AS session_id, q.turn AS at, 0 AS part, 'user' AS role, md5(q.text) AS content_md5 FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant' UNION ALL SELECT q.conv_id, q.turn, 1, 'assistant', md5(a.text) FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'")
def m8_exchanges(spark, d):
    c = table(prepare(spark), d, "conversations")
    q = c.where(F.col("role") == "user").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("at"), F.col("text").alias("question"))
    a = c.where(F.col("role") == "assistant").select(F.col("conv_id").alias("session_id"), (F.col("turn") - 1).alias("at"), F.col("text").alias("answer"))
    usage = {x: F.lit(None).cast("long") for x in ("input_tokens", "cache_read_tokens", "cache_write_tokens", "output_tokens")}
    log = q.join(a, ["session_id", "at"]).withColumns(usage | {"cost_usd": F.lit(None).cast("double")})
    return merge.exchanges(log).select("session_id", "at", "part", "role", F.md5(F.encode("content", "utf-8")).alias("content_md5"))


@query(f"{WITH} SELECT 'jobs' AS t, count(*) AS n FROM jobs WHERE id % 10 <> 1 UNION ALL SELECT 'outcomes', count(*) FROM outcomes WHERE job_id NOT IN (SELECT id FROM jobs WHERE id % 10 = 1)")
def m9_delete_cascade(spark, d):
    left, right = merge.delete(jobs(spark, d), outcomes(spark, d), jobs(spark, d).where(F.col("id") % 10 == 1).select("id"))
    return left.agg(F.lit("jobs").alias("t"), F.count("*").alias("n")).unionByName(right.agg(F.lit("outcomes").alias("t"), F.count("*").alias("n")))


@query(f"{WITH}, w AS (SELECT *, sum(CASE WHEN status IN ('applied', 'closed') THEN 1 ELSE 0 END) OVER (PARTITION BY dedupe_key) AS states, row_number() OVER (PARTITION BY dedupe_key ORDER BY CASE WHEN status IN ('applied', 'closed') THEN 1 ELSE 0 END DESC, id) AS n FROM jobs) SELECT id, dedupe_key, status FROM w WHERE dedupe_key IS NULL OR states > 1 OR n = 1")
def m10_merge_collisions(spark, d):
    return merge.merge_collisions(jobs(spark, d)).select("id", "dedupe_key", "status")


# Screening

_SCREEN = """base AS (SELECT doc_id AS id, length(text) AS n, trim(coalesce(text, '')) = '' OR regexp_matches(lower(text), '(?:^|[^\\p{L}\\p{N}_])(intern|internship|apprentice|new[- ]grad|are)(?:$|[^\\p{L}\\p{N}_])') AS word,
 CASE doc_id % 6 WHEN 0 THEN 'platform' WHEN 1 THEN 'sre' WHEN 2 THEN 'sales' WHEN 3 THEN NULL ELSE 'devops' END AS family, doc_id % 19 = 0 AS triage_error, doc_id % 23 = 0 AS gate_error, doc_id % 7 = 0 AS gate, doc_id % 2 = 0 AS worth, doc_id % 50 AS sketch FROM documents),
 staged AS (SELECT *, CASE WHEN word OR n < 200 THEN 'rules' WHEN NOT triage_error AND coalesce(family, '') NOT IN ('platform', 'devops', 'build-release', 'developer-experience', 'infrastructure', 'sre') THEN 'triage' WHEN gate_error THEN 'error' ELSE 'gates' END AS stage FROM base),
 judged AS (SELECT *, stage = 'error' OR (stage = 'gates' AND NOT gate AND NOT (NOT worth AND sketch < 25)) AS keep FROM staged)"""


def _screened(spark, d):
    i = F.col("doc_id")
    gates = F.when(i % 7 == 0, F.array(F.struct(F.lit("visa").alias("gate"), F.lit("none").alias("evidence")))).otherwise(F.array(F.struct(F.lit("pay").alias("gate"), F.lit(" ").alias("evidence"))))
    p = table(prepare(spark), d, "documents").select(
        i.alias("id"), i.alias("pos"), F.col("text").alias("title"), F.col("text").alias("description"),
        F.when(i % 6 == 0, "platform").when(i % 6 == 1, "sre").when(i % 6 == 2, "sales").when(i % 6 == 3, F.lit(None)).otherwise("devops").alias("family"),
        F.when(i % 19 == 0, "timeout").alias("triage_error"), F.when(i % 23 == 0, "timeout").alias("gate_error"), gates.alias("gate_failures"), (i % 2 == 0).alias("worth"), (i % 50).cast("int").alias("fit_sketch"),
    )
    return screening.screen(p, extra_titles=["are"])


@query(f"WITH {_SCREEN} SELECT id, stage, keep FROM judged")
def d3_d4_d5_screen(spark, d):
    return _screened(spark, d).select("id", "stage", "keep")


@query(f"WITH {_SCREEN} SELECT id FROM judged WHERE keep AND stage <> 'error' ORDER BY sketch DESC, id LIMIT 25")
def d7_submittable(spark, d):
    return screening.submittable(_screened(spark, d)).select("id")


@query(f"WITH {_SCREEN} SELECT stage, keep, count(*) AS n FROM judged GROUP BY stage, keep")
def a8_decisions_by_stage(spark, d):
    return _screened(spark, d).groupBy("stage", "keep").agg(F.count("*").alias("n"))


# Counters and windows

_RUN = "OVER (PARTITION BY user_id, floor(epoch(ts) / 3600) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT event_id, count(*) {_RUN} AS n_requests, count(*) {_RUN} <= 3 AS within FROM events")
def t1_t2_request_limit(spark, d):
    return windows.request_limit(table(prepare(spark), d, "events"), "user_id", limit=3).select("event_id", "n_requests", "within")


@query("SELECT event_id, coalesce(count(*) OVER (PARTITION BY user_id, floor(epoch(ts) / 86400) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 4 AS within FROM events")
def t2_budget_limit(spark, d):
    return windows.budget_limit(table(prepare(spark), d, "events"), "user_id", F.lit(1.0), limit=4.0).select("event_id", "within")


@query("WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) > 43200 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM g) SELECT user_id, CAST(session_no AS BIGINT) AS session_no, count(*) AS n_events FROM s GROUP BY user_id, session_no")
def t4_sessions(spark, d):
    return windows.sessions(table(prepare(spark), d, "events"), "user_id").select("user_id", "session_no", "n_events")


@query("SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL")
def t5_daily_sessions(spark, d):
    return table(prepare(spark), d, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT event_id, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 2 AS dead FROM events")
def t6_breaker(spark, d):
    return windows.breaker(table(prepare(spark), d, "events"), "user_id", F.col("event_type") == "error", "event_id").select("event_id", "dead")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def o11_newest(spark, d):
    return windows.newest(table(prepare(spark), d, "events"), "ts", 200, tie="event_id").select("event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 12")
def o12_last_turns(spark, d):
    return windows.newest(table(prepare(spark), d, "events"), "ts", 12, key="user_id", tie="event_id").select("user_id", "event_id")


# URLs and text

_TRACK = "|".join(urls.TRACKING)


@query(f"SELECT page_id, CASE WHEN regexp_matches(url, '^[a-z]+://[^/?#]+/(?:[?#]|$)') THEN regexp_extract(url, '^([^?#]*)', 1) ELSE regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', '') END || CASE WHEN coalesce(q, '') = '' THEN '' ELSE '?' || q END AS canonical FROM (SELECT page_id, url, array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.+$') AND NOT regexp_matches(p, '^({_TRACK})=')), '&') AS q FROM pages)")
def x1_canonical_url(spark, d):
    return table(prepare(spark), d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


_UNTAGGED = "regexp_replace(html, '<[^>]+>', ' ', 'g')"


@query(f"WITH {unescaped_sql(_UNTAGGED)} SELECT page_id, md5(regexp_replace(regexp_replace(text, '[\\s\u00a0]+', ' ', 'g'), '^ | $', '', 'g')) AS text_md5 FROM plain")
def x15_strip_html(spark, d):
    return table(prepare(spark), d, "pages").select("page_id", F.md5(F.encode(text.strip_html(F.col("html")), "utf-8")).alias("text_md5"))


@query(f"WITH {MESSAGES} SELECT session_id, floor(sum((input_tokens * 3.0::DOUBLE + output_tokens * 15.0::DOUBLE) / 1000000) * 1000000 + 0.5) / 1000000 AS cost_usd FROM messages GROUP BY session_id")
def x22_token_cost(spark, d):
    usage = {"input": F.col("input_tokens"), "output": F.col("output_tokens"), "cache_read": F.lit(None).cast("long"), "cache_write": F.lit(None).cast("long")}
    cost = F.sum(rows.token_cost(usage, F.lit(3.0), F.lit(15.0)))
    return messages(spark, d).groupBy("session_id").agg((F.floor(cost * 1_000_000 + 0.5) / 1_000_000).alias("cost_usd"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'web:' || user_id WHEN 1 THEN 'mcp:c1:' || user_id ELSE 'fetch:c1:' || strftime(ts, '%Y-%m-%d') END AS session_key FROM events")
def x23_session_key(spark, d):
    k = F.col("event_id") % 3
    surface = F.when(k == 0, "web").when(k == 1, "mcp").otherwise("fetch")
    return table(prepare(spark), d, "events").select("event_id", rows.session_key(surface, F.lit("c1"), F.col("user_id").cast("string"), F.col("ts")).alias("session_key"))


@query(f"{WITH} SELECT id, regexp_replace(lower(company), '[^a-z0-9]+', '', 'g') || '-' || CAST(id AS VARCHAR) || '-20240131' AS branch FROM jobs")
def p7_branch_name(spark, d):
    return jobs(spark, d).select("id", rows.branch_name(F.col("company"), F.col("id"), as_of()).alias("branch"))


@query(f"{WITH} SELECT id FROM jobs WHERE status = 'closed' UNION SELECT id FROM jobs WHERE gated = 1")
def u1_union_distinct(spark, d):
    j = jobs(spark, d)
    return j.where(F.col("status") == "closed").select("id").union(j.where(F.col("gated") == 1).select("id")).distinct()


