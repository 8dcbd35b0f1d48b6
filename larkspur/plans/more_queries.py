"""Queries over the driver's tables for ingest, targets, lookups, reports and helpers, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import dates, prompts, ranking, rows, text, urls
from larkspur.operators import filters, ingest, lookup, merge, order, report, screening, targets, views, windows
from larkspur.session import prepare, table
from larkspur.sources import files, thread

from .data import JOBS, RANK_SQL, _day, as_of, jobs, outcomes
from .queries import WITH, _screened, _values, query


def _i():
    return F.col("doc_id")


def _docs(spark, d):
    return table(prepare(spark), d, "documents")


def _pages(spark, d):
    return table(prepare(spark), d, "pages")


def _cat(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# Rows and text


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'new' || doc_id WHEN 1 THEN 'old' || doc_id ELSE '' END AS summary, CASE doc_id % 2 WHEN 0 THEN 'a' || doc_id ELSE 'b,c' END AS strengths,
 CASE WHEN doc_id % 5 = 0 THEN 'g' ELSE '' END AS gaps, CASE WHEN doc_id % 7 = 0 THEN 'consider' END AS recommendation FROM documents""")
def p3_normalised_analysis(spark, d):
    made = F.to_json(F.struct(
        F.when(_i() % 3 == 0, _cat("new", _i())).when(_i() % 3 == 1, F.lit("")).alias("candidate_explanation"), F.when(_i() % 3 < 2, _cat("old", _i())).alias("summary"),
        F.when(_i() % 2 == 0, F.array(_cat("a", _i()))).alias("candidate_strengths"), F.array(F.lit("b"), F.lit("c")).alias("strengths"),
        F.when(_i() % 5 < 2, F.array().cast("array<string>")).alias("candidate_deficiencies"), F.when(_i() % 5 == 0, F.array(F.lit("g"))).alias("gaps"), F.when(_i() % 7 == 0, "consider").alias("recommendation"),
    ))
    n = _docs(spark, d).select("doc_id", rows.normalised_analysis(made).alias("n"))
    return n.select("doc_id", "n.summary", F.array_join("n.strengths", ",").alias("strengths"), F.array_join("n.gaps", ",").alias("gaps"), "n.recommendation")


@query("""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'Acme Tools X' || doc_id WHEN 1 THEN 'O''Neil ' || doc_id || 'B' WHEN 2 THEN 'Health Edge ' || doc_id WHEN 3 THEN 'Nvidia' || doc_id WHEN 4 THEN 'Unnamed' WHEN 5 THEN 'Www' || doc_id WHEN 6 THEN 'Unnamed' ELSE 'Plain ' || doc_id END AS name FROM documents""")
def p8_display_name(spark, d):
    k = _i() % 8
    entry = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    ident = (
        F.when(k == 0, entry("board", _cat("acme-tools_x", _i()))).when(k == 1, entry("company", _cat("o'neil ", _i(), "b"))).when(k == 2, entry("tenant", _cat("careers-health-edge-", _i())))
        .when((k == 3) | (k == 4), entry("host", _cat("NVIDIA", _i(), ".wd5.myworkdayjobs.com"))).when(k == 7, entry("board", F.lit(""), "slug", _cat("PLAIN-", _i()))).otherwise(F.create_map().cast("map<string,string>"))
    )
    url = F.when(k == 5, _cat("https://WWW", _i(), ".example.com/x")).otherwise(F.lit("no address"))
    return _docs(spark, d).select("doc_id", rows.display_name(ident, F.when(k == 3, "workday").otherwise("other"), url).alias("name"))


@query(f"""{WITH}, named AS (SELECT id, description, CASE WHEN id % 5 > 0 THEN company END AS company, CASE WHEN id % 3 > 0 THEN 'Title ' || repeat('x', CAST(id % 80 AS INTEGER)) END AS title FROM jobs)
 SELECT id, substr(CASE WHEN company IS NOT NULL AND title IS NOT NULL THEN company || ' — ' || title ELSE coalesce(company, title, '(untitled)') END, 1, 70) AS headline,
 md5(regexp_replace(coalesce(nullif(regexp_extract(description, '^[^.!?]*[.!?]'), ''), description, ''), '^\\s+|\\s+$', '', 'g')) AS sentence_md5 FROM named""")
def p11_headline(spark, d):
    i = F.col("id")
    title = F.when(i % 3 > 0, F.concat(F.lit("Title "), F.repeat(F.lit("x"), (i % 80).cast("int"))))
    return jobs(spark, d).select("id", text.headline(F.when(i % 5 > 0, F.col("company")), title).alias("headline"), F.md5(F.encode(text.first_sentence(F.col("description")), "utf-8")).alias("sentence_md5"))


@query(f"{WITH} SELECT id, CASE WHEN desirability_score >= 80 THEN '#28a745' WHEN desirability_score >= 60 THEN '#17a2b8' WHEN desirability_score >= 40 THEN '#ffc107' WHEN desirability_score IS NOT NULL THEN '#dc3545' END AS color FROM jobs")
def p12_badge(spark, d):
    return jobs(spark, d).select("id", rows.badge_color(F.col("desirability_score")).alias("color"))


_PARTS = "doc_id, 'a b c' || CASE WHEN doc_id % 4 = 0 THEN ' d e f g' ELSE '' END AS company, CASE doc_id % 7 WHEN 0 THEN 'Engineer' WHEN 1 THEN '70k' WHEN 2 THEN 'New York, NY' WHEN 3 THEN 'QA' WHEN 4 THEN 'remote' WHEN 5 THEN '$120,000 - 150k' ELSE 'Lead, Data' END AS title, text || CASE WHEN doc_id % 2 = 0 THEN ' apply' ELSE '' END AS t"


@query(f"SELECT doc_id, length(t) >= 200 AND regexp_matches(lower(t), '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join([*text.HIRING, *text.HIRING_PAIRS, 'full-time'])})([^\\p{{L}}\\p{{N}}_]|$)') AND doc_id % 7 IN (0, 6) AND doc_id % 4 <> 0 AS plausible FROM (SELECT {_PARTS} FROM documents)")
def f15_plausible_posting(spark, d):
    k = _i() % 7
    title = F.when(k == 0, "Engineer").when(k == 1, "70k").when(k == 2, "New York, NY").when(k == 3, "QA").when(k == 4, "remote").when(k == 5, "$120,000 - 150k").otherwise("Lead, Data")
    company = F.when(_i() % 4 == 0, "a b c d e f g").otherwise("a b c")
    return _docs(spark, d).select("doc_id", text.looks_like_posting(company, title, F.concat("text", F.when(_i() % 2 == 0, " apply").otherwise(""))).alias("plausible"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'x|y' WHEN 1 THEN '' WHEN 2 THEN 'a|b c' ELSE '' END AS listed FROM documents")
def f4_csv_setting(spark, d):
    raw = F.when(_i() % 4 == 0, F.lit(None).cast("string")).when(_i() % 4 == 1, "").when(_i() % 4 == 2, " a ,, b c,").otherwise(" , ")
    return _docs(spark, d).select("doc_id", F.array_join(filters.csv_or_default(raw, ["x", "y"]), "|").alias("listed"))


_ACCESS = "CASE WHEN event_id % 11 = 0 THEN 'revoked' WHEN ts < TIMESTAMP '2024-01-10' OR event_id % 4 > 0 THEN 'ok' ELSE 'expired' END"


@query(f"SELECT event_id, event_id % 13 <> 0 AND {_ACCESS} = 'ok' AND (event_id % 2 = 0 OR event_id % 3 = 0) AS granted FROM events")
def f17_access(spark, d):
    i = F.col("event_id")
    expires = F.when((F.col("ts") >= "2024-01-10") & (i % 4 == 0), "2024-01-05").otherwise("")
    status = filters.code_status((i % 11 == 0).cast("int"), expires, as_of())
    return table(prepare(spark), d, "events").select("event_id", filters.access_granted(status, i % 13 != 0, i % 2 == 1, F.when(i % 3 == 0, 1)).alias("granted"))


@query(f"SELECT id, md5('Rate it.' || chr(10) || chr(10) || '<job_posting>' || chr(10) || 'URL: ' || url || chr(10) || 'Title: n/a' || chr(10) || 'ATS Platform: ' || CASE WHEN id % 2 = 0 THEN ats_platform ELSE 'unknown' END || chr(10) || 'Description:' || chr(10) || substr(description, 1, 12000) || chr(10) || '</job_posting>') AS message_md5 FROM (WITH {JOBS} SELECT * FROM jobs)")
def x26_message(spark, d):
    own = prompts.user_message(F.lit("Rate it."), F.col("description"), F.col("url"), F.lit(None).cast("string"), F.when(F.col("id") % 2 == 0, F.col("ats_platform")))
    return jobs(spark, d).select("id", F.md5(F.encode(own, "utf-8")).alias("message_md5"))


@query("SELECT conv_id, 'title: ' || CASE conv_id % 3 WHEN 0 THEN 'T' || conv_id ELSE 'notes/' || conv_id || '.md' END || ' | type: ' || CASE WHEN conv_id % 2 = 0 THEN 'note' ELSE 'notes' END || CASE WHEN conv_id % 5 = 0 THEN ' | tags: a, b' ELSE '' END AS header FROM (SELECT DISTINCT conv_id FROM conversations)")
def x21_document_header(spark, d):
    c = F.col("conv_id")
    meta = F.create_map(F.lit("title"), F.when(c % 3 == 0, _cat("T", c)).otherwise(""), F.lit("type"), F.when(c % 2 == 0, "note"), F.lit("tags"), F.when(c % 5 == 0, "a, b").otherwise(""))
    return table(prepare(spark), d, "conversations").select("conv_id").distinct().select("conv_id", files.header(_cat("notes/", c, ".md"), meta).alias("header"))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, (SELECT arg_max(line, (length(line), -pos)) FROM (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) WHERE length(line) > 0 AND length(line) < 300) AS longest FROM documents")
def o14_longest_line(spark, d):
    return _docs(spark, d).select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), ingest.longest(F.split("text", "\n"), 300).alias("longest"))


# Addresses


@query("""SELECT page_id, label, CASE WHEN label IS NULL OR label = 'careers' THEN '' ELSE label || ',' || label || 'jobs' || CASE WHEN contains(label, '-') THEN ',' || replace(label, '-', '') || ',' || replace(label, '-', '') || 'jobs' ELSE '' END END AS candidates
 FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN list_extract(string_split(h, '.'), -2) WHEN 1 THEN 'acme-' || page_id WHEN 2 THEN NULL ELSE 'careers' END AS label FROM (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS h FROM pages))""")
def x9_board_candidates(spark, d):
    k = F.col("page_id") % 4
    host = F.when(k == 0, urls.netloc(F.col("url"))).when(k == 1, _cat("Jobs.acme-", F.col("page_id"), ".co.uk")).when(k == 2, "localhost").otherwise("www.careers.com")
    return _pages(spark, d).select("page_id", urls.registrable_label(host).alias("label"), F.array_join(urls.board_candidates(host), ",").alias("candidates"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://boards.greenhouse.io/acme' || page_id WHEN 1 THEN 'https://boards.greenhouse.io/b-' || page_id WHEN 2 THEN 'https://jobs.ashbyhq.com/org' || page_id WHEN 3 THEN 'https://jobs.lever.co/lev' || page_id WHEN 4 THEN 'https://t' || page_id || '.wd1.myworkdayjobs.com/en-US/Site' END AS board FROM pages""")
def x7_embedded_board(spark, d):
    i = F.col("page_id")
    tail = (
        F.when(i % 6 == 0, _cat('<script src="https://boards.greenhouse.io/embed/job_board/js?for=acme', i, '"></script>')).when(i % 6 == 1, _cat('<a href="https://job-boards.greenhouse.io/b-', i, '/jobs/1">x</a>'))
        .when(i % 6 == 2, _cat('<iframe src="https://jobs.ashbyhq.com/org', i, '?x"></iframe> jobs.lever.co/later')).when(i % 6 == 3, _cat("jobs.lever.co/lev", i)).when(i % 6 == 4, _cat("'https://t", i, ".wd1.myworkdayjobs.com/en-US/Site?q'")).otherwise("")
    )
    return _pages(spark, d).select("page_id", urls.embedded_board(F.concat("html", tail)).alias("board"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN CAST(page_id * 100 AS VARCHAR) WHEN 1 THEN 'JR' || page_id WHEN 2 THEN '0a1b2c3d' ELSE 'row' || page_id END AS posting, page_id % 2 = 0 AS same_origin FROM pages""")
def x13_posting_id(spark, d):
    i = F.col("page_id")
    url = F.when(i % 5 == 0, _cat("https://boards.greenhouse.io/a/jobs/", i * 100)).when(i % 5 == 1, _cat("https://t.wd1.myworkdayjobs.com/S/job/x_JR", i)).when(i % 5 == 2, _cat("https://jobs.lever.co/a/0a1b2c3d-", i)).when(i % 5 == 3, "https://t.wd1.myworkdayjobs.com/S/job/x_R-1").otherwise(F.col("url"))
    platform = F.when(i % 5 == 0, "greenhouse").when(i % 5 == 2, "lever").when(i % 5 == 4, "other").otherwise("workday")
    other = F.when(i % 2 == 0, F.regexp_replace(F.upper(urls.netloc(F.col("url"))), "$", "")).otherwise(_cat("x", urls.netloc(F.col("url"))))
    return _pages(spark, d).select("page_id", urls.posting_id(url, platform, _cat("row", i)).alias("posting"), urls.same_origin(F.col("url"), _cat(urls.scheme(F.col("url")), "://", other, "/y")).alias("same_origin"))


@query("SELECT page_id, 'a/' || page_id || '%20b%26c~' AS quoted FROM pages")
def x24_url_quote(spark, d):
    return _pages(spark, d).select("page_id", urls.url_quote(_cat("a/", F.col("page_id"), " b&c~")).alias("quoted"))


# Ranking and orders


_CURRENT_RANK = f"""variant AS (SELECT id, least(100.0::DOUBLE, greatest(0.0::DOUBLE, least(100.0::DOUBLE, CASE WHEN desirability_score IS NOT NULL THEN desirability_score * 0.7::DOUBLE + fit_score * 0.3::DOUBLE ELSE fit_score * 0.6::DOUBLE END + CASE WHEN id % 97 = 3 THEN -30.0::DOUBLE WHEN id % 97 = 5 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END)) * decay * factor) AS live, gated, fit_score FROM parts)
 SELECT id, floor(CASE WHEN gated = 1 THEN fit_score * 0.05::DOUBLE ELSE live END * 100 + 0.5) / 100 AS rank FROM variant"""


@query(f"{RANK_SQL}, {_CURRENT_RANK}")
def r1_adjusted_pending(spark, d):
    given = views.company_adjustment(jobs(spark, d), _values(spark, "pos int, name string, points double", [(1, "company 3", -30.0), (2, "company 5", 10.0)]).where(F.lit(True)))
    exact = F.when(F.lower("company").isin("company 3", "company 5"), F.col("adjustment")).otherwise(0.0)
    return views.live_rank(given, outcomes(spark, d), as_of(), preferences=True, adjustment=exact).select("id", ranking.shown(F.col("live_rank")).alias("rank"))


@query(f"{RANK_SQL} SELECT id, row_number() OVER (ORDER BY live_rank DESC NULLS LAST, id DESC) AS place FROM ranked")
def o2_list_order(spark, d):
    return order.numbered(views.live_rank(jobs(spark, d), outcomes(spark, d), as_of()).select("id", "live_rank"), F.desc_nulls_last("live_rank"), F.desc("id")).select("id", "place")


@query(f"{WITH} SELECT id, row_number() OVER (ORDER BY applied_at DESC NULLS LAST, discovered_at DESC, id DESC) AS place FROM jobs")
def o3_applied_order(spark, d):
    return order.numbered(jobs(spark, d).select("id", "applied_at", "discovered_at"), F.desc_nulls_last("applied_at"), F.desc("discovered_at"), F.desc("id")).select("id", "place")


@query(f"{WITH} SELECT id, row_number() OVER (ORDER BY {_day('posted_at')} DESC NULLS LAST, id) AS place FROM jobs")
def o4_newest_first(spark, d):
    return order.numbered(jobs(spark, d).select("id", dates.iso_date(F.col("posted_at")).alias("day")), F.desc_nulls_last("day"), F.col("id")).select("id", "place")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations")
def o13_transcript(spark, d):
    return thread.transcript(table(prepare(spark), d, "conversations"), "conv_id").select("conv_id", "turn", "place")


@query("SELECT source, string_agg(lang, ',' ORDER BY first, lang) AS langs FROM (SELECT source, lang, min(doc_id) AS first FROM (SELECT source, lang, doc_id FROM documents UNION ALL SELECT source, 'xx', doc_id FROM documents) GROUP BY source, lang) GROUP BY source")
def u4_u5_concatenated_distinct(spark, d):
    both = _docs(spark, d).select("source", "lang", "doc_id").unionByName(_docs(spark, d).select("source", F.lit("xx").alias("lang"), "doc_id"))
    firsts = both.groupBy("source", "lang").agg(F.min("doc_id").alias("first"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("first", "lang"))), lambda x: x["lang"])
    return firsts.groupBy("source").agg(F.array_join(F.array_distinct(listed), ",").alias("langs"))


# Counters and lookups


@query("""WITH failures AS (SELECT event_id, user_id, ts, floor(epoch(ts) / 3600) AS w FROM events WHERE event_type = 'error')
 SELECT event_id, count(*) OVER (PARTITION BY user_id, w ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 < 10 AS address_ok, count(*) OVER (PARTITION BY w ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 < 100 AS all_ok FROM failures""")
def t2_failure_limits(spark, d):
    failures = table(prepare(spark), d, "events").where(F.col("event_type") == "error").select("event_id", "user_id", "ts")
    own = windows.failure_limit(failures, "user_id", windows.FAILURES_PER_HOUR, out="address_ok")
    return windows.running(own, F.lit(1), out="n").select("event_id", "address_ok", (F.col("n") - 1 < windows.FAILURES_PER_HOUR_ALL).alias("all_ok"))


@query("SELECT event_id, coalesce(sum(value) OVER (PARTITION BY floor(epoch(ts) / 86400) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 25 AS within FROM (SELECT event_id, ts, CAST(event_id % 4 AS DOUBLE) / 4 AS value FROM events)")
def t2_budget_of_all(spark, d):
    e = table(prepare(spark), d, "events").select("event_id", "ts", ((F.col("event_id") % 4).cast("double") / 4).alias("cost"))
    return windows.running(e, F.col("cost"), size=windows.DAY, out="spent").select("event_id", (F.col("spent") - F.col("cost") < windows.DOLLARS_PER_DAY_ALL).alias("within"))


@query("SELECT user_id, CAST(w AS BIGINT) AS \"window\", n FROM (SELECT user_id, floor(epoch(ts) / 3600) AS w, count(*) AS n FROM events GROUP BY ALL) WHERE w >= floor(epoch(TIMESTAMP '2024-01-15 00:30:00') / 3600)")
def t3_live_counters(spark, d):
    counters = table(prepare(spark), d, "events").groupBy("user_id", windows.window_number(F.col("ts"), windows.HOUR).alias("window")).agg(F.count("*").alias("n"))
    return windows.live_counters(counters, F.lit("2024-01-15 00:30:00").cast("timestamp"), windows.HOUR)


_NOW = "TIMESTAMP '2024-01-20 12:00:00'"


@query(f"SELECT user_id, event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS last, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE ts <= {_NOW}) WHERE n <= 12 AND floor(epoch({_NOW})) - floor(epoch(last)) <= 1800 * 20")
def o12_live_turns(spark, d):
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    e = table(prepare(spark), d, "events").where(F.col("ts") <= now)
    return lookup.last_turns(e, now, key="user_id", at="ts", tie="event_id", seconds=1800 * 20).select("user_id", "event_id")


@query("SELECT user_id FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id DESC LIMIT 30")
def o11_kept_entries(spark, d):
    return lookup.kept_entries(table(prepare(spark), d, "events"), 30, key="user_id", at="ts").select("user_id")


@query(f"""WITH cache AS (SELECT user_id % 400 AS key, CASE WHEN event_id % 3 = 0 THEN value END AS score, ts FROM events), newest AS (SELECT key, arg_max({{'score': score}}, ts) AS e, max(ts) AS newest_ts FROM cache WHERE ts < {_NOW} GROUP BY key),
 store AS (SELECT doc_id AS key, CAST(doc_id % 100 AS DOUBLE) AS score FROM documents WHERE doc_id % 4 = 0), asked AS (SELECT doc_id AS key FROM documents)
 SELECT a.key, CASE WHEN n.e.score IS NOT NULL THEN 'cache' WHEN n.key IS NOT NULL AND floor(epoch({_NOW})) - floor(epoch(n.newest_ts)) < 86400 THEN 'known miss' WHEN s.key IS NOT NULL THEN 'store' ELSE 'miss' END AS source,
 CASE WHEN n.e.score IS NOT NULL THEN n.e.score WHEN n.key IS NOT NULL AND floor(epoch({_NOW})) - floor(epoch(n.newest_ts)) < 86400 THEN NULL ELSE s.score END AS score FROM asked a LEFT JOIN newest n USING (key) LEFT JOIN store s USING (key)""")
def d17_cached_scores(spark, d):
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    cache = table(prepare(spark), d, "events").where(F.col("ts") < now).select((F.col("user_id") % 400).alias("key"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("score"), F.col("ts").alias("at"))
    store = _docs(spark, d).where(_i() % 4 == 0).select(_i().alias("key"), (_i() % 100).cast("double").alias("score"))
    return lookup.cached_scores(_docs(spark, d).select(_i().alias("key")), cache, store, now, 86_400)


@query("""WITH calls AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages) SELECT page_id, host, coalesce(sum(CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 1 AS dead FROM calls""")
def t6_refused_hosts(spark, d):
    """Whether a host had refused before each call to it: one refusal is enough. Hosts may hold any share of the calls."""
    calls = _pages(spark, d).select("page_id", F.lower(urls.netloc(F.col("url"))).alias("host"), (F.col("page_id") % 7 == 0).cast("int").alias("refused"))
    counted = windows.running(calls, F.col("refused"), ["host"], at="page_id", tie="refused", size=None, out="n")
    return counted.select("page_id", "host", (F.col("n") - F.col("refused") >= 1).alias("dead"))


# Ingest


@query(f"{WITH}, p AS (SELECT id, url, CASE WHEN id % 3 = 0 THEN '' ELSE 'd' || id END AS description, CASE WHEN id % 4 > 0 THEN posted_at END AS posted_at FROM jobs), det AS (SELECT url, 'detail ' || min(id) AS description, '2024-02-0' || (min(id) % 9 + 1) AS posted_at FROM jobs WHERE id % 2 = 0 GROUP BY url) SELECT p.id, coalesce(nullif(p.description, ''), det.description, '') AS description, coalesce(p.posted_at, det.posted_at) AS posted_at FROM p LEFT JOIN det USING (url)")
def s16_details(spark, d):
    i = F.col("id")
    j = jobs(spark, d)
    postings = j.select("id", "url", F.when(i % 3 == 0, "").otherwise(_cat("d", i)).alias("description"), F.when(i % 4 > 0, F.col("posted_at")).alias("posted_at"))
    first = j.where(i % 2 == 0).groupBy("url").agg(F.min("id").alias("n"))
    details = first.select("url", _cat("detail ", F.col("n")).alias("description"), _cat("2024-02-0", F.col("n") % 9 + 1).alias("posted_at"))
    return ingest.with_details(postings, details).select("id", "description", "posted_at")


_SNAPSHOT = "CASE source WHEN 'src0' THEN NULL WHEN 'src1' THEN 'none' ELSE 'listed' END"


@query(f"""WITH s AS (SELECT source, {_SNAPSHOT} AS given, doc_id FROM documents) SELECT 'poller' AS reader, source, 'k' || doc_id AS key FROM s WHERE given = 'listed' UNION ALL SELECT 'discovery', source, 'k' || doc_id FROM s WHERE given = 'listed'
 UNION ALL SELECT 'poller', source, 'gh:' || doc_id FROM s WHERE given IS NULL UNION ALL SELECT 'discovery', source, 'gh:' || doc_id FROM s WHERE coalesce(given, 'none') = 'none'""")
def s26_seen_keys(spark, d):
    given = F.when(F.col("source") == "src0", F.lit(None)).when(F.col("source") == "src1", F.array(F.lit(""))).otherwise(F.array(_cat("k", _i()), F.lit("")))
    snapshots = _docs(spark, d).select("source", given.cast("array<string>").alias("dedupe_keys"), F.array(_cat("https://acme.example/?gh_jid=", _i())).alias("urls"))
    readers = [ingest.known_keys(snapshots, empty_counts=strict).select(F.lit(name).alias("reader"), "source", "key") for name, strict in (("poller", True), ("discovery", False))]
    return readers[0].unionByName(readers[1])


_INCOMING = """incoming AS (SELECT doc_id AS pos, CASE WHEN doc_id % 29 = 0 THEN '' WHEN doc_id % 31 = 0 THEN 'manual-paste-' || doc_id ELSE 'https://acme.example/?gh_jid=' || (doc_id % 300) END AS url,
  CASE WHEN doc_id % 10 = 0 THEN CAST(doc_id % 90 AS DOUBLE) END AS given, doc_id % 13 = 0 AS force, length(text) >= 100 AS long, text, source FROM documents),
 keyed AS (SELECT *, CASE WHEN url LIKE 'https%' THEN 'gh:' || regexp_extract(url, '=(.*)', 1) ELSE url END AS dedupe_key FROM incoming),
 own AS (SELECT doc_id AS id, 'gh:' || doc_id AS dedupe_key, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 77 AS DOUBLE) END AS fit_score, CASE doc_id % 3 WHEN 0 THEN 'applied' WHEN 1 THEN 'ranked' ELSE 'discovered' END AS status FROM documents WHERE doc_id < 200),
 fit AS (SELECT k.*, o.fit_score AS known, coalesce(given, CASE WHEN long AND pos % 3 > 0 AND url LIKE 'https%' THEN CAST(pos % 300 % 50 AS DOUBLE) END) AS fit FROM (SELECT *, CAST(regexp_extract(url, '=(.*)', 1) AS VARCHAR) AS jid FROM keyed) k LEFT JOIN own o USING (dedupe_key)),"""
# The scorer answers for addresses, of which three quarters are known to it.
_INCOMING = _INCOMING.replace("pos % 3 > 0 AND url LIKE 'https%' THEN CAST(pos % 300 % 50 AS DOUBLE)", "url LIKE 'https%' AND pos % 300 % 4 > 0 THEN CAST(pos % 300 % 50 AS DOUBLE)")
_JUDGED = """told AS (SELECT *, coalesce(known, first_value(fit IGNORE NULLS) OVER (PARTITION BY dedupe_key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS earlier FROM fit),
 responses AS (SELECT *, CASE WHEN url = '' THEN 'error' WHEN given IS NULL AND NOT force AND earlier IS NOT NULL THEN 'cached' WHEN fit IS NOT NULL THEN 'scored' ELSE 'stored' END AS outcome FROM told)"""


def _ingested(spark, d):
    docs = _docs(spark, d)
    url = F.when(_i() % 29 == 0, " ").when(_i() % 31 == 0, "manual-paste").otherwise(_cat("https://acme.example/?gh_jid=", _i() % 300, "&utm_source=x"))
    incoming = docs.select(_i().alias("pos"), url.alias("url"), F.lit("T").alias("title"), F.lit(None).cast("string").alias("company"), F.col("text").alias("description"), F.col("source").alias("ats_platform"), F.lit(None).cast("string").alias("posted_at"), F.when(_i() % 10 == 0, (_i() % 90).cast("double")).alias("fit_score"), (_i() % 13 == 0).alias("force"))
    current = docs.where(_i() < 200).select(
        _i().alias("id"), _cat("gh:", _i()).alias("dedupe_key"), _cat("https://acme.example/?gh_jid=", _i()).alias("url"), F.lit("Old").alias("title"), F.lit("Co").alias("company"), F.lit("d").alias("description"), F.col("source").alias("ats_platform"), F.lit(None).cast("string").alias("posted_at"),
        F.when(_i() % 2 == 0, (_i() % 77).cast("double")).alias("fit_score"), F.lit(None).cast("double").alias("desirability_score"), F.lit(0).alias("gated"), F.when(_i() % 3 == 0, "applied").when(_i() % 3 == 1, "ranked").otherwise("discovered").alias("status"), F.lit(None).cast("string").alias("applied_at"),
    )
    n = F.col("n")
    answers = prepare(spark).range(300).select(F.col("id").alias("n")).where(n % 4 > 0)
    scores = answers.select(_cat("https://acme.example/?gh_jid=", n).alias("url"), (n % 50).cast("double").alias("fit_score"), F.lit(50.0).alias("desirability_score"), F.lit(0).alias("gated"))
    return ingest.ingest(current, incoming, scores)


@query(f"WITH {_INCOMING} {_JUDGED} SELECT pos, url, dedupe_key, outcome, CASE WHEN outcome = 'cached' THEN earlier WHEN outcome <> 'error' THEN fit END AS fit_score FROM responses")
def d8_score_ingest(spark, d):
    return _ingested(spark, d)[0]


@query(f"""WITH {_INCOMING} {_JUDGED}, put AS (SELECT dedupe_key, arg_max(fit, pos) FILTER (fit IS NOT NULL) AS fit, bool_or(fit IS NOT NULL) AS ranked FROM responses WHERE outcome IN ('scored', 'stored') GROUP BY dedupe_key)
 SELECT id, coalesce(o.dedupe_key, p.dedupe_key) AS dedupe_key, coalesce(p.fit, o.fit_score) AS fit_score, CASE WHEN coalesce(status, 'discovered') = 'applied' OR p.dedupe_key IS NULL THEN coalesce(status, 'discovered') WHEN p.ranked THEN 'ranked' ELSE 'discovered' END AS status FROM own o FULL JOIN put p ON o.dedupe_key = p.dedupe_key""")
def d8_stored(spark, d):
    return _ingested(spark, d)[1].select("id", "dedupe_key", "fit_score", "status")


@query(f"{WITH} SELECT id, CASE WHEN length(description) < 100 THEN 'skipped' WHEN id % 4 = 0 THEN 'failed' ELSE 'done' END AS outcome, CASE WHEN length(description) >= 100 AND id % 4 <> 0 THEN CAST(id % 60 AS DOUBLE) ELSE fit_score END AS fit_score, CASE WHEN length(description) >= 100 AND id % 4 <> 0 THEN 33.0::DOUBLE END AS desirability_score FROM (SELECT * FROM jobs WHERE status IN ('discovered', 'ranked') AND fit_score IS NOT NULL AND desirability_score IS NULL ORDER BY fit_score DESC, id LIMIT 50)")
def d12_rescore(spark, d):
    j = jobs(spark, d).withColumn("url", _cat("u", F.col("id")))
    scores = j.where(F.col("id") % 4 != 0).select("url", (F.col("id") % 60).cast("double").alias("fit_score"), F.lit(33.0).alias("desirability_score"), F.lit(False).alias("gated"))
    return ingest.rescored(ingest.missing_desirability(j, 50), scores).select("id", "outcome", "fit_score", "desirability_score")


@query(f"{RANK_SQL} SELECT id, live_rank IS NULL AS unranked, floor(live_rank * 100 + 0.5) / 100 AS rank_score FROM ranked")
def d10_rerank(spark, d):
    j = jobs(spark, d).withColumn("rank_score", F.lit(-1.0))
    return views.reranked(j, outcomes(spark, d), as_of()).select("id", F.col("rank_score").isNull().alias("unranked"), ranking.shown(F.col("rank_score")).alias("rank_score"))


@query(f"{WITH} SELECT id FROM (SELECT *, CASE id % 3 WHEN 0 THEN '{{\"gate_failures\": []}}' WHEN 1 THEN '{{}}' END AS a FROM jobs) WHERE status IN ('discovered', 'ranked', 'applied') AND fit_score IS NOT NULL AND (a IS NULL OR a NOT ILIKE '%\"gate_failures\"%') ORDER BY fit_score DESC, id LIMIT 40")
def f11_missing_gates(spark, d):
    i = F.col("id")
    j = jobs(spark, d).withColumn("analysis_json", F.when(i % 3 == 0, '{"gate_failures": []}').when(i % 3 == 1, "{}"))
    return ingest.missing_gates(j, 40, rank="fit_score").select("id")


@query("SELECT doc_id, CASE WHEN length(text) > 200 AND doc_id % 2 = 0 THEN md5(text) ELSE 'scraped' END AS chosen FROM documents")
def d16_extraction(spark, d):
    chosen = ingest.extraction(F.lit("scraped"), F.when(_i() % 2 == 0, F.col("text")))
    return _docs(spark, d).select("doc_id", F.when(chosen == "scraped", chosen).otherwise(F.md5(F.encode(chosen, "utf-8"))).alias("chosen"))


@query(f"{WITH} SELECT id, CASE WHEN id % 3 = 0 THEN 'new ' || id ELSE company END AS title, id % 3 = 0 AS title_changed FROM jobs")
def m15_backfill_titles(spark, d):
    j = jobs(spark, d).select("id", F.col("company").alias("title"))
    fetched = j.where(F.col("id") % 3 < 2).select("id", F.when(F.col("id") % 3 == 0, _cat("new ", F.col("id"))).otherwise(F.col("title")).alias("title"))
    return merge.backfill_titles(j, fetched).select("id", "title", "title_changed")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'renamed ' || s_suppkey ELSE s_name END AS name, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN '[\"a' || s_suppkey || '\",\"b\"]' ELSE '[\"old\"]' END AS deny_list FROM supplier")
def m11_update_targets(spark, d):
    k = F.col("s_suppkey")
    s = table(prepare(spark), d, "supplier")
    current = s.select(k.alias("id"), F.col("s_name").alias("name"), F.lit('["old"]').alias("deny_list"))
    changes = s.where(k % 3 == 0).select(k.alias("id"), _cat("renamed ", k).alias("name"), F.when(k % 2 == 0, _cat(" a", k, "\n\n b ")).alias("deny_lines"))
    return merge.update_targets(current, changes)


@query("SELECT c_custkey AS code, CASE WHEN c_custkey % 5 = 0 THEN 'new' ELSE c_mktsegment END AS label, CASE WHEN c_custkey % 5 = 0 THEN 0 WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS revoked, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 4 <> 0 THEN 'cli' ELSE 'file' END AS source FROM (SELECT * FROM customer) WHERE true".replace("WHEN c_custkey % 2 = 0 THEN 1", "WHEN c_custkey % 2 = 0 AND c_custkey % 4 <> 0 THEN 1"))
def m7_codes(spark, d):
    k = F.col("c_custkey")
    c = table(prepare(spark), d, "customer")
    current = c.select(k.alias("code"), F.col("c_mktsegment").alias("label"), F.lit("").alias("expires"), F.lit(0).alias("url_auth"), F.lit(0).alias("revoked"), F.lit("").alias("note"), F.when(k % 4 == 0, "file").otherwise("cli").alias("source"), F.lit("t1").alias("created_at"))
    gone = merge.revoke_codes(current, c.where(k % 2 == 0).select(k.alias("code")))
    new = c.where(k % 5 == 0).select(k.alias("code"), F.lit("new").alias("label"), F.lit("").alias("expires"), F.lit(1).alias("url_auth"), F.lit("").alias("note"), F.lit("t2").alias("created_at"))
    return merge.put_codes(gone, new).select("code", "label", "revoked", "source")


@query("SELECT c.conv_id AS session_id, greatest(2, max(a.turn) FILTER (a.role = 'assistant')) AS last_active_at FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN conversations a USING (conv_id) GROUP BY c.conv_id")
def m8_touched_sessions(spark, d):
    c = table(prepare(spark), d, "conversations")
    sessions = c.select(F.col("conv_id").alias("session_id"), F.lit(2).cast(c.schema["turn"].dataType).alias("last_active_at")).distinct()
    return merge.touched_by(sessions, c.where(F.col("role") == "assistant").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("at")))


# Targets


@query("SELECT p.page_id FROM pages p WHERE EXISTS (SELECT 1 FROM pages t WHERE t.page_id % 50 = 0 AND (regexp_extract(t.url, '^[a-z]+://[^/?#]+') = p.url OR starts_with(p.url, regexp_extract(t.url, '^[a-z]+://[^/?#]+') || '/')))")
def j12_watched_already(spark, d):
    p = _pages(spark, d).select("page_id", F.col("url").alias("careers_url"))
    kept = p.where(F.col("page_id") % 50 == 0).select(F.regexp_extract("careers_url", "^[a-z]+://[^/?#]+", 0).alias("careers_url"))
    return targets.watched_already(p, kept).select("page_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def j11_unlisted(spark, d):
    own = _docs(spark, d).select("doc_id", _cat("AB-", _i()).alias("posting"))
    return targets.unlisted(own, _docs(spark, d).where(_i() % 3 == 0).select(_cat("ab-", _i()).alias("posting"))).select("doc_id")


@query("""SELECT doc_id AS pos, CASE doc_id % 10 WHEN 0 THEN 'missing' WHEN 1 THEN 'added' WHEN 2 THEN CASE WHEN doc_id % 20 = 2 THEN 'added' ELSE 'unverified' END WHEN 3 THEN CASE WHEN doc_id = 3 THEN 'added' ELSE 'existing' END WHEN 4 THEN 'existing' WHEN 5 THEN 'added' WHEN 6 THEN 'unsupported' WHEN 7 THEN 'added' WHEN 8 THEN 'added' ELSE 'added' END AS outcome,
 CASE doc_id % 10 WHEN 0 THEN '' WHEN 1 THEN 'https://jobs.lever.co/acme-' || doc_id WHEN 2 THEN 'https://boards.greenhouse.io/b' || doc_id WHEN 3 THEN 'https://jobs.ashbyhq.com/one' WHEN 4 THEN 'https://jobs.lever.co/known' || doc_id WHEN 5 THEN 'https://boards.greenhouse.io/van' || doc_id || 'jobs' WHEN 6 THEN 'https://plain' || doc_id || '.example.com/careers'
  WHEN 7 THEN 'https://jobs.lever.co/emb' || doc_id WHEN 8 THEN 'https://t' || doc_id || '.icims.com/jobs/search?ss=1' ELSE 'https://w' || doc_id || '.wd1.myworkdayjobs.com/en-US/Site' END AS careers_url,
 CASE doc_id % 10 WHEN 0 THEN 'Unnamed' WHEN 1 THEN 'Acme ' || doc_id WHEN 2 THEN CASE WHEN doc_id % 20 = 2 THEN 'Board ' || doc_id ELSE 'B' || doc_id END WHEN 3 THEN 'Given' WHEN 4 THEN 'Known' || doc_id WHEN 5 THEN 'Van ' || doc_id WHEN 6 THEN 'Plain' || doc_id WHEN 7 THEN 'Emb' || doc_id WHEN 8 THEN 'T' || doc_id ELSE 'W' || doc_id END AS name FROM documents""")
def d14_register_target(spark, d):
    k = _i() % 10
    url = (
        F.when(k == 0, "  ").when(k == 1, _cat("https://jobs.lever.co/acme-", _i())).when(k == 2, _cat("https://boards.greenhouse.io/b", _i())).when(k == 3, " https://jobs.ashbyhq.com/one").when(k == 4, _cat("https://jobs.lever.co/known", _i()))
        .when(k == 5, _cat("https://careers.van", _i(), ".com/jobs/1000", _i())).when(k == 6, _cat("https://plain", _i(), ".example.com/careers")).when(k == 7, _cat("https://emb", _i(), ".example.com/careers")).when(k == 8, _cat("https://t", _i(), ".icims.com/jobs/7/a/job")).otherwise(_cat("https://w", _i(), ".wd1.myworkdayjobs.com/en-US/Site"))
    )
    docs = _docs(spark, d)
    asked = docs.select(_i().alias("pos"), url.alias("careers_url"), F.when(k == 3, "Given").alias("name"))
    current = docs.where(k == 4).select(url.alias("careers_url"))
    postings = docs.where(k == 5).select(_cat("van", _i(), "jobs").alias("board"), _cat("1000", _i()).alias("job_id"))
    pages = docs.where(k.isin(6, 7)).select(url.alias("careers_url"), F.when(k == 7, _cat("x jobs.lever.co/emb", _i())).otherwise("x").alias("html"))
    verified = docs.where(((k == 2) & (_i() % 20 == 2)) | k.isin(5, 8, 9)).select(
        F.when(k == 8, "icims").when(k == 9, "workday").otherwise("greenhouse").alias("platform"),
        F.when(k == 2, _cat("b", _i())).when(k == 5, _cat("van", _i(), "jobs")).when(k == 8, _cat("t", _i())).otherwise(_cat("w", _i(), ".wd1.myworkdayjobs.com/Site")).alias("board"),
        F.when(k == 2, _cat("Board ", _i())).when(k == 5, _cat("Van ", _i())).alias("name"),
    )
    return targets.register(asked, current, postings=postings, pages=pages, boards=verified).select("pos", "outcome", "careers_url", "name")


# Screening and reports


def _decisions(spark, d):
    return _screened(spark, d).withColumns({"company": _cat("Company ", F.col("id") % 97), "url": _cat("u", F.col("id") % 600)})


_SCREEN_SQL = """base AS (SELECT doc_id AS id, length(text) AS n, trim(coalesce(text, '')) = '' OR regexp_matches(lower(text), '(?:^|[^\\p{L}\\p{N}_])(intern|internship|apprentice|new[- ]grad|are)(?:$|[^\\p{L}\\p{N}_])') AS word,
 CASE doc_id % 6 WHEN 0 THEN 'platform' WHEN 1 THEN 'sre' WHEN 2 THEN 'sales' WHEN 3 THEN NULL ELSE 'devops' END AS family, doc_id % 19 = 0 AS triage_error, doc_id % 23 = 0 AS gate_error, doc_id % 7 = 0 AS gate, doc_id % 2 = 0 AS worth, doc_id % 50 AS sketch FROM documents),
 staged AS (SELECT *, CASE WHEN word OR n < 200 THEN 'rules' WHEN NOT triage_error AND coalesce(family, '') NOT IN ('platform', 'devops', 'build-release', 'developer-experience', 'infrastructure', 'sre') THEN 'triage' WHEN gate_error THEN 'error' ELSE 'gates' END AS stage FROM base),
 judged AS (SELECT *, 'Company ' || (id % 97) AS company, 'u' || (id % 600) AS url, stage = 'error' OR (stage = 'gates' AND NOT gate AND NOT (NOT worth AND sketch < 25)) AS keep FROM staged)"""


@query(f"WITH {_SCREEN_SQL} SELECT id, company, url, keep, stage, sketch AS fit_sketch, CASE WHEN gate THEN 'visa: none' ELSE 'pay:  ' END AS gates FROM judged")
def p10_report_rows(spark, d):
    return report.report_rows(_decisions(spark, d)).select("id", "company", "url", "keep", "stage", F.col("fit_sketch").cast("long").alias("fit_sketch"), "gates")


@query(f"WITH {_SCREEN_SQL} SELECT id, row_number() OVER (ORDER BY keep DESC, company, id) AS place FROM judged")
def o5_decision_order(spark, d):
    return report.ordered(_decisions(spark, d)).select("id", "place")


@query(f"WITH {_SCREEN_SQL} SELECT id, row_number() OVER (ORDER BY sketch DESC, id) AS place FROM judged WHERE keep")
def o5_kept_order(spark, d):
    return report.kept_by_sketch(_decisions(spark, d)).select("id", "place")


@query(f"WITH {_SCREEN_SQL} SELECT id AS pos, company, CASE WHEN gate THEN 'visa' ELSE 'pay' END AS gate, CASE WHEN gate THEN 'none' ELSE ' ' END AS evidence FROM judged WHERE NOT keep AND stage = 'gates' ORDER BY id LIMIT 40")
def o10_gate_drops(spark, d):
    return report.gate_drops(_decisions(spark, d)).select("pos", "company", "gate", "evidence")


@query(f"WITH {_SCREEN_SQL}, src AS (SELECT 'u' || (doc_id % 550) AS url, max(doc_id) AS last FROM documents GROUP BY 1) SELECT id, CASE WHEN last IS NULL THEN 'discovery' ELSE 's' || last END AS source FROM judged LEFT JOIN src USING (url)")
def j6_decision_sources(spark, d):
    postings = _docs(spark, d).select(_cat("u", _i() % 550).alias("url"), _i().alias("pos"), _cat("s", _i()).alias("source"), F.lit("2024-01-01").alias("posted_at"), F.lit("x").alias("description"))
    return report.with_sources(_decisions(spark, d).drop("description"), postings).select("id", "source")


@query(f"WITH {_SCREEN_SQL} SELECT stage AS action, count(*) AS n, row_number() OVER (ORDER BY stage) AS place FROM judged GROUP BY stage")
def a12_action_summary(spark, d):
    return report.action_summary(_decisions(spark, d).withColumnRenamed("stage", "action"))


@query("""SELECT doc_id, stage, stage IN ('error', 'kept') AS keep FROM (SELECT doc_id, CASE WHEN doc_id % 17 = 0 OR length(trim(text)) < 200 THEN 'rules' WHEN doc_id % 19 = 0 THEN 'error' WHEN doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 THEN 'triage' WHEN doc_id % 23 = 0 THEN 'error' WHEN doc_id % 11 = 0 OR (doc_id % 2 = 1 AND doc_id % 50 < 25) THEN 'gates' ELSE 'kept' END AS stage FROM documents)""")
def d6_single_screen(spark, d):
    p = _docs(spark, d).select(
        "doc_id", F.when(_i() % 17 == 0, " ").when(_i() % 7 == 0, "Senior Engineer").otherwise("Engineer").alias("title"), F.col("text").alias("description"), (_i() % 3 == 0).alias("triage_keep"), F.when(_i() % 5 == 0, "unclear").otherwise("mid").alias("triage_level"),
        F.when(_i() % 19 == 0, "timeout").alias("triage_error"), F.when(_i() % 23 == 0, "timeout").alias("gate_error"), F.array(F.struct(F.lit("visa").alias("gate"), F.when(_i() % 11 == 0, "none").otherwise(" ").alias("evidence"))).alias("gate_failures"), (_i() % 2 == 0).alias("worth"), (_i() % 50).cast("int").alias("fit_sketch"),
    )
    return screening.screen_single(p).select("doc_id", "stage", "keep")


# The thread source

_STORIES = [(1, "Ask HN: Who is hiring? (January 2024)", "2024-01-02"), (2, "Ask HN: Who is hiring? (February 2024)", "2024-02-01"), (3, "Ask HN: Freelancer? Who is hiring?", "2024-02-02"), (4, "ask hn: who is hiring? freelance only", "2024-02-03"), (5, "Show HN: a thing", "2024-02-04")]


@query("""SELECT doc_id AS comment_id, 'Acme ' || doc_id AS company, CASE WHEN doc_id % 5 = 0 THEN 'Data Engineer' ELSE 'Lead' END AS title, 'https://jobs.lever.co/a/' || doc_id AS url, 'hn:Ask HN: Who is hiring? (February 2024)' AS source, '2024-02-01' AS posted_at
 FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 <> 0 AND (doc_id % 5 = 0 OR doc_id % 7 = 0) ORDER BY doc_id LIMIT 500""")
def s17_thread(spark, d):
    stories = _values(spark, "story_id long, title string, created_at string", _STORIES)
    head = F.when(_i() % 5 == 0, _cat("Acme ", _i(), " | REMOTE | Data Engineer | US")).when(_i() % 7 == 0, _cat("Acme ", _i(), " - Lead - full-time")).otherwise("only a remark")
    link = F.when(_i() % 4 != 0, _cat('see <a href="x">https://x.com/y</a> https://example.org/z and https://jobs.lever.co/a/', _i(), "."))
    body = _cat(head, "<p>We&#x27;re hiring. ", F.repeat(F.lit("word "), 60), "<p>", F.coalesce(link, F.lit("no address")))
    comments = _docs(spark, d).select(_i().alias("comment_id"), F.when(_i() % 3 == 0, 2).otherwise(_i() + 100).cast("long").alias("parent_id"), body.alias("comment_text"), F.lit("2024-02-01T10:00:00Z").alias("created_at"))
    return thread.thread_postings(thread.latest_thread(stories), comments).select("comment_id", "company", "title", "url", "source", "posted_at")
