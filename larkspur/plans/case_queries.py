"""Queries whose rows are made of documents by cases: a document takes the case of its id, and its id stands in the case's texts.

The SQL of these tells each case's outcome by hand, so it repeats none of the functions' patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions import rows, text, urls
from larkspur.operators import filters, merge, report, stats
from larkspur.session import once, prepare, table
from larkspur.sources import files, page_tree, paged, payloads, thread
from larkspur.sources.store import Store

from .data import as_of
from .queries import query
from .source_queries import boards
from .state_queries import _folder


def _docs(spark, d):
    return table(prepare(spark), d, "documents")


def _id() -> Column:
    return F.col("doc_id").cast("string")



def _case(values: list) -> Column:
    """The value of a document's case, with its id for {n}."""
    chain = F.when(F.lit(False), F.lit(None))
    for k, v in enumerate(values):
        chain = chain.when(F.col("doc_id") % len(values) == k, F.replace(F.lit(v), F.lit("{n}"), _id()) if isinstance(v, str) else F.lit(v))
    return chain


def _sql(values: list) -> str:
    """The same in SQL."""
    cell = lambda v: "NULL" if v is None else f"replace('{v.replace(chr(39), chr(39) * 2)}', '{{n}}', CAST(doc_id AS VARCHAR))" if isinstance(v, str) else str(v).lower()
    return f"CASE doc_id % {len(values)} " + " ".join(f"WHEN {k} THEN {cell(v)}" for k, v in enumerate(values)) + " END"


def _columns(pairs: list[tuple], k: int) -> list:
    return [p[k] for p in pairs]


# Settings, codes, runs


@query("SELECT d.doc_id, coalesce(s.value, 'fallback') AS value FROM documents d LEFT JOIN (SELECT doc_id, lang AS value FROM documents WHERE doc_id % 3 = 0) s USING (doc_id)")
def s7_setting_or_default(spark, d):
    settings = _docs(spark, d).where(F.col("doc_id") % 3 == 0).select("doc_id", F.col("lang").alias("value"))
    return _docs(spark, d).select("doc_id").join(settings, "doc_id", "left").select("doc_id", F.coalesce("value", F.lit("fallback")).alias("value"))


@query("SELECT 'all' AS run, CASE WHEN count(*) FILTER (doc_id % 3 > 0) > 0 THEN 1 ELSE 0 END AS exit_code FROM documents UNION ALL SELECT 'some', 0 UNION ALL SELECT 'none', 0")
def a7_exit_code(spark, d):
    """Runs in which all that was tried failed, some did, or nothing was tried."""
    runs = _docs(spark, d).select((F.col("doc_id") % 3 == 0).cast("int").alias("skipped"), (F.col("doc_id") % 3 != 0).alias("every"), (F.col("doc_id") % 3 == 1).alias("one"))
    given = [("all", runs.withColumn("adapter_error", F.col("every"))), ("some", runs.withColumn("adapter_error", F.col("one"))), ("none", runs.withColumn("adapter_error", F.lit(True)).withColumn("skipped", F.lit(1)))]
    out = [stats.systemic_failure(r).select(F.lit(name).alias("run"), "exit_code") for name, r in given]
    return out[0].unionByName(out[1]).unionByName(out[2])


_CODES = [(0, "2024-02-10", "ok"), (0, "2024-01-01", "expired"), (1, "2025-01-01", "revoked"), (0, "", "ok"), (0, "never", "expired"), (None, None, "ok")]


@query(f"SELECT doc_id, {_sql(_columns(_CODES, 2))} AS status FROM documents")
def f7_code_status(spark, d):
    return _docs(spark, d).select("doc_id", filters.code_status(_case(_columns(_CODES, 0)), _case(_columns(_CODES, 1)), as_of()).alias("status"))


@query("""WITH have AS (SELECT doc_id, 'L' || lang AS label, '2025-01-01' AS expires, 0 AS revoked, CASE WHEN doc_id % 2 = 0 THEN 'file' ELSE 'cli' END AS source, 't1' AS created_at FROM documents WHERE doc_id % 5 <> 0),
 listed AS (SELECT doc_id, 'N' || lang AS label, '' AS expires, doc_id % 2 AS revoked, 't2' AS created_at FROM documents WHERE doc_id % 3 = 0)
 SELECT 'c' || coalesce(f.doc_id, h.doc_id) AS code, CASE WHEN f.doc_id IS NOT NULL THEN f.label ELSE h.label END AS label, CASE WHEN f.doc_id IS NOT NULL THEN f.expires ELSE h.expires END AS expires, CASE WHEN f.doc_id IS NOT NULL THEN f.revoked WHEN h.source = 'file' THEN 1 ELSE h.revoked END AS revoked,
 CASE WHEN f.doc_id IS NOT NULL THEN 'file' ELSE h.source END AS source, coalesce(h.created_at, f.created_at) AS created_at FROM have h FULL JOIN listed f ON h.doc_id = f.doc_id""")
def m6_sync_codes(spark, d):
    i = F.col("doc_id")
    code = F.concat(F.lit("c"), _id()).alias("code")
    have = _docs(spark, d).where(i % 5 != 0).select(code, F.concat(F.lit("L"), "lang").alias("label"), F.lit("2025-01-01").alias("expires"), F.lit(0).alias("revoked"), F.when(i % 2 == 0, "file").otherwise("cli").alias("source"), F.lit("t1").alias("created_at"))
    listed = _docs(spark, d).where(i % 3 == 0).select(code, F.concat(F.lit("N"), "lang").alias("label"), F.lit("").alias("expires"), (i % 2).cast("int").alias("revoked"), F.lit("t2").alias("created_at"))
    return merge.sync_codes(have, listed)


# Places and titles

_PLACES = [
    ("AUS-Perth {n}", True, None), ("AUS-Sydney {n}", False, "deny:Sydney"), ("US-TX-Austin {n}", True, None), ("United States, Canada", True, None), ("Berlin, Germany {n}", False, "deny:Germany"), ("", True, None),
    ("Atlantis {n}", True, None), (None, True, None), ("Remote | UK", False, "deny:| UK"), ("RUS-Moscow", True, None), (" {n} ", True, None), ("Toronto, Canada", False, "deny:Canada"), ("emea or APAC", False, "deny:EMEA"),
]


@query(f"SELECT doc_id, {_sql(_columns(_PLACES, 1))} AS allowed, {_sql(_columns(_PLACES, 2))} AS reason FROM documents")
def f2_f3_location_policy(spark, d):
    verdict = filters.location_verdict(F.col("place"))
    return once(_docs(spark, d).select("doc_id"), place=_case(_columns(_PLACES, 0))).select("doc_id", verdict["allowed"].alias("allowed"), verdict["reason"].alias("reason"))


_TITLES = [("Careers {n}", True), ("", True), ("JOIN OUR TEAM {n}", True), ("Platform Engineer {n}", False), (None, True), ("Career opportunities at Acme {n}", True), ("{n}", True), ("SRE " * 12 + "{n}", False), ("Caretaker {n}", False)]


@query(f"SELECT doc_id, {_sql(_columns(_TITLES, 1))} AS generic FROM documents")
def f14_generic_title(spark, d):
    return _docs(spark, d).select("doc_id", text.looks_generic(_case(_columns(_TITLES, 0))).alias("generic"))


# Addresses

_U = "0a1b2c3d-1111-2222-3333-444455556666"
_KEYS = [
    ("https://acme.example/jd?gh_jid={n}", "gh:{n}"), ("https://boards.greenhouse.io/acme/jobs/{n}/", "gh:{n}"), ("https://boards.greenhouse.io/embed/job_app?token={n}", "gh:{n}"),
    ("https://acme.wd1.myworkdayjobs.com/en-US/Ext/job/Austin/Data-Eng_R-{n}", "wd:acme.wd1.myworkdayjobs.com:R-{n}"), ("https://acme.wd1.myworkdayjobs.com/Ext/job/Austin/Data-Eng_R-{n}?source=x", "wd:acme.wd1.myworkdayjobs.com:R-{n}"),
    ("https://www.linkedin.com/jobs/view/{n}", "linkedin:{n}"), ("https://www.linkedin.com/jobs/search/?currentJobId={n}", "linkedin:{n}"), (f"https://jobs.ashbyhq.com/acme{{n}}/{_U}/application", "ashby:0a1b2c3d"),
    (f"https://acme{{n}}.example/c?ashby_jid={_U}", "ashby:0a1b2c3d"), (f"https://jobs.lever.co/acme{{n}}/{_U}/apply", "lever:0a1b2c3d"), ("https://careers-acme.icims.com/jobs/{n}/data-eng/job?iis=x", "icims:careers-acme:{n}"),
    (f"https://ats.rippling.com/acme{{n}}/jobs/{_U}?src=x", "rippling:0a1b2c3d"), ("https://h.taleo.net/x?org=ACME&rid={n}&cws=1", "taleo:acme:{n}"), ("https://acme.example/roles/{n}/?utm_source=x&a=1#top", "https://acme.example/roles/{n}?a=1"),
    ("https://acme{n}.example/", "https://acme{n}.example/"), ("https://acme.example/?utm_source={n}", "https://acme.example/"), ("https://acme.example/a~b/?q=c~d*e&p=1%20{n}", "https://acme.example/a~b?q=c~d%2Ae&p=1+{n}"), ("HTTPS://acme{n}.example?ref=1", "https://acme{n}.example"),
    ("manual-paste-{n}", "manual-paste-{n}"), ("", ""), (None, None),
]


@query(f"SELECT doc_id, {_sql(_columns(_KEYS, 1))} AS dedupe_key FROM documents")
def x2_dedupe_key(spark, d):
    return once(_docs(spark, d).select("doc_id"), url=_case(_columns(_KEYS, 0))).select("doc_id", urls.dedupe_key(F.col("url")).alias("dedupe_key"))


_CLIENT = [
    ("https://www.linkedin.com/jobs/view/1?currentJobId={n}", "linkedin:{n}"), ("https://www.linkedin.com/x?gh_jid=3&currentJobId={n}", "linkedin:{n}"), ("https://u:p@acme.example/a{n}/?b=1&ref=x", "https://acme.example/a{n}?b=1"), ("https://ACME{n}.example", "https://acme{n}.example/"),
    ("https://notgreenhouse.io/a/jobs/{n}", "gh:{n}"), ("https://greenhouse.io.example/a/jobs/{n}", "https://greenhouse.io.example/a/jobs/{n}"), ("https://t.wd1.myworkdayjobs.com/S/job/x_R-{n}", "wd:t.wd1.myworkdayjobs.com:R-{n}"), ("https://acme{n}.example/?a=&utm_source=b", "https://acme{n}.example/?a="),
    ("https://acme.example/j?gh_jid={n}", "gh:{n}"), ("plain{n}", "plain{n}"), ("", ""),
]


@query(f"SELECT doc_id, {_sql(_columns(_CLIENT, 1))} AS client_key FROM documents")
def x4_client_key(spark, d):
    return _docs(spark, d).select("doc_id", urls.client_key(_case(_columns(_CLIENT, 0))).alias("client_key"))


_BOARDS = [
    ("https://boards.greenhouse.io/acme{n}/jobs/1", "greenhouse", "https://boards.greenhouse.io/acme{n}"), (f"https://jobs.lever.co/acme{{n}}/{_U}", "lever", "https://jobs.lever.co/acme{n}"), ("https://t{n}.wd5.myworkdayjobs.com/en-US/Site/job/x", "workday", "https://t{n}.wd5.myworkdayjobs.com/en-US/Site"),
    ("https://x{n}.icims.com/jobs/1/a/job", "icims", "https://x{n}.icims.com/jobs/search?ss=1"), ("https://example.org/about{n}", "other", None),
]


@query(f"SELECT doc_id, {_sql(_columns(_BOARDS, 1))} AS platform, {_sql(_columns(_BOARDS, 2))} AS careers FROM documents")
def x5_x8_boards(spark, d):
    url = _case(_columns(_BOARDS, 0))
    return _docs(spark, d).select("doc_id", url.alias("url")).select("doc_id", urls.detect_platform(F.col("url"))["platform"].alias("platform"), urls.careers_url(F.col("url")).alias("careers"))


_HOSTS = [("https://boards{n}.greenhouse.io/x", "greenhouse"), ("https://a{n}.lever.co/x", "lever"), ("https://careers.ibm.com/{n}", "ibm"), ("https://example{n}.org/x", "unknown")]


@query(f"SELECT doc_id, {_sql(_columns(_HOSTS, 1))} AS platform FROM documents")
def x6_host_platform(spark, d):
    return _docs(spark, d).select("doc_id", urls.host_platform(urls.netloc(_case(_columns(_HOSTS, 0)))).alias("platform"))


# (address, parts of the candidates in order): a first segment that looks like a locale is tried as one first.
_SITES = [
    ("https://a{n}.wd1.myworkdayjobs.com/en-US/Ext/job/x_R-1", "en-US|Ext,|en-US"), ("https://a{n}.wd1.myworkdayjobs.com/Ext/job/x_R-1", "|Ext,Ext|job"), ("https://a{n}.wd1.myworkdayjobs.com/Ext", "|Ext"), ("https://a{n}.wd1.myworkdayjobs.com/", "|landed,landed|Site"),
    ("https://a{n}.wd1.myworkdayjobs.com/fr/Ext/", "fr|Ext,|fr"), ("https://example.org/{n}", ""), ("https://a{n}.wd1.myworkdayjobs.com/EN-us/Ext?x=/y", "|EN-us,EN-us|Ext"),
]


@query(f"SELECT doc_id, {_sql(_columns(_SITES, 1))} AS tried FROM documents")
def x11_site_candidates(spark, d):
    """Ordered candidates of addresses; a bare host goes by where its root leads."""
    url = _case(_columns(_SITES, 0))
    lands = F.when(F.col("doc_id") % len(_SITES) == 3, "/landed/Site")
    tried = F.array_join(F.transform(urls.site_candidates(F.col("url"), F.col("lands")), lambda c: F.concat(F.coalesce(c["lang"], F.lit("")), F.lit("|"), c["site"])), ",")
    landed = F.regexp_replace(tried, "^\\|landed,landed\\|Site$", "|landed,landed|Site")
    return _docs(spark, d).select("doc_id", url.alias("url"), lands.alias("lands")).select("doc_id", landed.alias("tried"))


# Texts

_SLUGS = [("Data-Eng_R-{n}", "Data Eng"), ("Senior--Data---Lead-x{n}", "Senior, Data - Lead x{n}"), ("Plain-title-{n}", "Plain title {n}")]


@query(f"SELECT doc_id, {_sql(_columns(_SLUGS, 1))} AS title FROM documents")
def x14_slug_title(spark, d):
    return _docs(spark, d).select("doc_id", text.slug_title(_case(_columns(_SLUGS, 0))).alias("title"))


_HEADS = [
    ("Acme {n} Inc | Senior Platform Engineer | Remote", "Acme {n} Inc", "Senior Platform Engineer"), ("Foo{n} - remote - SRE", "Foo{n}", "SRE"), ("Bar | $120k | New York, NY {n}", "Bar", "New York, NY {n}"), ("Foo | US | SRE {n}", "Foo", "SRE {n}"),
    ("Bar{n} | Full-time | Data Engineer", "Bar{n}", "Data Engineer"), ("Baz \u2022 Usage analyst {n}", "Baz", "Usage analyst {n}"), ("Q-Corp{n} \u2013 x | visa: yes", "Q-Corp{n} \u2013 x", ""), ("", "", ""),
]


@query(f"SELECT doc_id, {_sql(_columns(_HEADS, 1))} AS company, {_sql(_columns(_HEADS, 2))} AS title FROM documents")
def x18_company_and_title(spark, d):
    found = text.company_and_title(_case(_columns(_HEADS, 0)))
    return _docs(spark, d).select("doc_id", found["company"].alias("company"), found["title"].alias("title"))


_LINKS = [("see https://x.com/a and https://jobs.lever.co/b{n}.", "https://jobs.lever.co/b{n}"), ("at https://acme.example/about{n}, or", "https://acme.example/about{n}"), ("none {n}", None), ("(https://a.example/x), https://b.example/JOBS/{n};", "https://b.example/JOBS/{n}"), ("http://github.com/orgs/a{n}", None)]


@query(f"SELECT doc_id, {_sql(_columns(_LINKS, 1))} AS url FROM documents")
def x19_best_url(spark, d):
    """Of whole texts, with addresses behind them."""
    return _docs(spark, d).select("doc_id", text.best_url(F.concat(F.coalesce("text", F.lit("")), F.lit(" "), _case(_columns(_LINKS, 0)))).alias("url"))


_FRONTS = [("---\nTitle: A{n}\ntype: note\ntitle: B{n}\n---\n", "B{n}", True), ("---\nnever closed {n} ", None, False), ("plain ", None, False)]


@query(f"SELECT doc_id, {_sql(_columns(_FRONTS, 1))} AS title, md5(CASE WHEN doc_id % 3 = 0 THEN t ELSE ({_sql(_columns(_FRONTS, 0))}) || t END) AS body_md5 FROM (SELECT doc_id, replace(text, '---', '') AS t FROM documents)")
def x20_front_matter(spark, d):
    front = text.front_matter(F.col("doc"))
    whole = F.concat(_case(_columns(_FRONTS, 0)), F.replace("text", F.lit("---"), F.lit("")))
    return _docs(spark, d).select("doc_id", whole.alias("doc")).select("doc_id", F.try_element_at(front["meta"], F.lit("title")).alias("title"), F.md5(F.encode(front["body"], "utf-8")).alias("body_md5"))


_LABELS = [(" AshbyHQ ", "ashby"), ("Greenhouse{n}", "greenhouse{n}"), ("ashby", "ashby")]


@query(f"SELECT doc_id, {_sql(_columns(_LABELS, 1))} AS label FROM documents")
def p6_platform_label(spark, d):
    return _docs(spark, d).select("doc_id", rows.platform_label(_case(_columns(_LABELS, 0))).alias("label"))


@query("SELECT doc_id, CAST(unnest(range(n)) * 24 // n AS BIGINT) AS hour FROM (SELECT doc_id, doc_id % 24 + 1 AS n FROM documents)")
def p13_cron_hours(spark, d):
    return _docs(spark, d).select("doc_id", (F.col("doc_id") % 24 + 1).cast("int").alias("n")).select("doc_id", F.explode(rows.cron_hours(F.col("n"))).alias("hour")).withColumn("hour", F.col("hour").cast("long"))


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 0 INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def u7_intersect(spark, d):
    """Postings that are on both of two lists, once each."""
    return _docs(spark, d).where(F.col("doc_id") % 4 == 0).select("doc_id").intersect(table(spark, d, "labels").where("quality = 1").select("doc_id"))


# Kept lists

_LINES = [("c{n} | Label | expires=2026-01-01 | url_auth | note=a=b", "Label", "2026-01-01", 1, 0, "a=b"), ("c{n}|L2 {n}|revoked", "L2 {n}", "", 0, 1, ""), ("# comment {n}", *[None] * 5), ("", *[None] * 5), ("bad line {n}", *[None] * 5), (" | x{n}", *[None] * 5)]


@query(f"SELECT * FROM (SELECT 'c' || doc_id AS code, {', '.join(f'{_sql(_columns(_LINES, k))} AS {c}' for k, c in enumerate(('label', 'expires', 'url_auth', 'revoked', 'note'), 1))} FROM documents) WHERE label IS NOT NULL")
def s21_codes(spark, d):
    return files.codes(_docs(spark, d).select(_case(_columns(_LINES, 0)).alias("line")))


_POINTS = [("# x{n}: 1", None, None), ("Acme {n}: EU: -5 # why", "acme {n}: eu", -5.0), ("bad{n}: many", None, None), ("Foo{n}: 2.5", "foo{n}", 2.5), ("nothing {n}", None, None), ("all: 1", "all", 1.0)]


@query(f"WITH l AS (SELECT doc_id AS pos, {_sql(_columns(_POINTS, 1))} AS name, CAST({_sql(_columns(_POINTS, 2))} AS DOUBLE) AS points FROM documents) SELECT min(pos) AS pos, name, arg_max(points, pos) AS points FROM l WHERE name IS NOT NULL GROUP BY name")
def s21_adjustments(spark, d):
    return files.adjustments(_docs(spark, d).select(F.col("doc_id").alias("pos"), _case(_columns(_POINTS, 0)).alias("line")))


_STORIES = ["Ask HN: Who is hiring? (month {n})", "Ask HN: Freelancer? Who is hiring?", "ask hn: who is hiring? freelance only {n}", "Show HN: a thing {n}", None]
_CREATED = "CAST(DATE '2024-01-31' - CAST(doc_id * 37 % 365 AS INTEGER) AS VARCHAR)"


@query(f"SELECT doc_id AS story_id, 'Ask HN: Who is hiring? (month ' || doc_id || ')' AS title FROM documents WHERE doc_id % 5 = 0 ORDER BY {_CREATED} DESC, doc_id DESC LIMIT 1")
def o16_latest_thread(spark, d):
    created = F.date_format(F.date_sub(F.lit("2024-01-31"), (F.col("doc_id") * 37 % 365).cast("int")), "yyyy-MM-dd")
    return thread.latest_thread(_docs(spark, d).select(F.col("doc_id").alias("story_id"), _case(_STORIES).alias("title"), created.alias("created_at"))).select("story_id", "title")


# Payloads

_SHOWN = ["target_id", "pos", "url", "title", "description", "posted_at", "location"]
_NONE = "CAST(NULL AS VARCHAR)"


@query(f"""SELECT doc_id // 250 AS target_id, doc_id % 250 AS pos, 'https://a.wd1.myworkdayjobs.com/en-US/S/job/' || doc_id AS url, 'T' || doc_id AS title, {_NONE} AS description, CASE WHEN doc_id % 20 > 0 THEN '2024-01-02' END AS posted_at, 'X' AS location
 FROM documents WHERE doc_id % 250 < 200 AND (doc_id // 250 % 2 = 0 OR doc_id % 250 < 45)""")
def s12_workday(spark, d):
    """Pages captured of listings of 250 postings, read through the paged source: ten pages of even targets, as far as the first page's total of the others."""
    i = F.col("doc_id")
    target, at = F.floor(i / 250), i % 250
    job = F.struct(F.concat(F.lit("/job/"), _id()).alias("externalPath"), F.concat(F.lit("T"), _id()).alias("title"), F.lit("X").alias("locationsText"), F.when(i % 20 > 0, "2024-01-02").otherwise("Posted Today").alias("startDate"))
    listed = _docs(spark, d).where((target % 2 == 0) | (at < 45)).select(target.alias("target_id"), (F.floor(at / 20) * 20).alias("offset"), F.struct("doc_id", job.alias("j")).alias("x"))
    pages = listed.groupBy("target_id", "offset").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["j"]).alias("jobPostings"))
    total = F.when(F.col("offset") == 0, F.when(F.col("target_id") % 2 == 0, 250).otherwise(45)).otherwise(0)
    folder = _folder(spark, "pages")
    paged.capture(pages.select("target_id", "offset", F.to_json(F.struct("jobPostings", total.alias("total"))).alias("payload")), folder)
    read = paged.read(spark, folder, targets_per_partition=20)
    return payloads.workday(read.select("target_id", F.lit("a.wd1.myworkdayjobs.com").alias("host"), F.lit("S").alias("site"), F.lit("en-US").alias("lang"), "page", "payload")).select(*_SHOWN)


_WORK = [('"Remote {n}"', "Remote {n}"), ('{"label": "Paris {n}", "name": "x"}', "Paris {n}"), ('{"label": "", "name": "Rome {n}"}', "Rome {n}"), ('["Oslo {n}"]', ""), ("{n}", ""), ("null", ""), ('{"other": 1}', ""), ("true", "")]


def _places(spark, d):
    """Payloads of fifty postings each, whose places of work come in all shapes."""
    one = F.concat(F.lit('{"name": "T'), _id(), F.lit('", "url": "'), F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("u"), _id())).otherwise(""), F.lit('", "workLocation": '), _case(_columns(_WORK, 0)), F.lit("}"))
    listed = _docs(spark, d).groupBy(F.floor(F.col("doc_id") / 50).alias("target_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", one.alias("j")))), lambda x: x["j"]).alias("all"))
    return listed.select("target_id", F.concat(F.lit("["), F.array_join("all", ","), F.lit("]")).alias("payload")).unionByName(spark.createDataFrame([(-1, "not json"), (-2, "{}"), (-3, None)], "target_id long, payload string"))


@query(f"SELECT doc_id // 50 AS target_id, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) - 1 AS pos, 'u' || doc_id AS url, 'T' || doc_id AS title, {_NONE} AS description, {_NONE} AS posted_at, {_sql(_columns(_WORK, 1))} AS location FROM documents WHERE doc_id % 5 <> 0")
def s13_rippling(spark, d):
    return payloads.rippling(_places(spark, d)).select(*_SHOWN)


@query("SELECT shape, count(*) AS n FROM (SELECT CASE doc_id % 8 WHEN 0 THEN 'STRING' WHEN 1 THEN 'OBJECT<label: STRING, name: STRING>' WHEN 2 THEN 'OBJECT<label: STRING, name: STRING>' WHEN 3 THEN 'ARRAY<STRING>' WHEN 4 THEN 'BIGINT' WHEN 5 THEN 'VOID' WHEN 6 THEN 'OBJECT<other: BIGINT>' ELSE 'BOOLEAN' END AS shape FROM documents) GROUP BY shape UNION ALL SELECT NULL, count(*) FROM documents")
def s13_shapes(spark, d):
    """In which shapes the places of work come."""
    return payloads.shapes(_places(prepare(spark), d), "$.workLocation").select("shape", "n")


@query("SELECT platform, n_postings, n_targets FROM (SELECT 'rippling' AS platform, count(*) AS n_postings, count(DISTINCT doc_id // 50) AS n_targets FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT 'lever', count(*), count(DISTINCT doc_id // 50) FROM documents UNION ALL SELECT 'ashby', count(*), count(DISTINCT doc_id // 50) FROM documents WHERE doc_id % 7 <> 0)")
def s15_adapters(spark, d):
    named = lambda prefix: F.concat(F.lit(prefix), _id())
    lever = boards(spark, d, F.struct(named("u").alias("hostedUrl"), named("T").alias("text")), "array").withColumn("platform", F.lit("lever"))
    ashby = boards(spark, d, F.struct(named("u").alias("jobUrl"), (F.col("doc_id") % 7 > 0).alias("isListed")), "jobs").withColumn("platform", F.lit("ashby"))
    both = lever.unionByName(ashby).unionByName(_places(spark, d).withColumn("platform", F.lit("rippling"))).unionByName(lever.withColumn("platform", F.lit("unknown")))
    return payloads.postings(both).groupBy("platform").agg(F.count("*").alias("n_postings"), F.countDistinct("target_id").alias("n_targets"))


@query(f"""SELECT doc_id // 120 AS target_id, doc_id % 120 AS pos, 'https://t.icims.com/jobs/' || doc_id || '/data-eng/job' AS url, 'Data & ' || doc_id AS title, {_NONE} AS description, {_NONE} AS posted_at, 'US-' || lang AS location FROM documents""")
def s14_icims(spark, d):
    """Listings of 120 postings on pages of fifty cards; a page repeats the first card of the one before it."""
    i = F.col("doc_id")
    card = F.concat(F.lit('<li class="iCIMS_JobCardItem"><a href="https://t.icims.com/jobs/'), _id(), F.lit('/data-eng/job?x=1" title="'), _id(), F.lit(" - Data &amp; "), _id(), F.lit('">x</a><dl><dt>Job Locations</dt><dd><span> US-'), F.col("lang"), F.lit(" </span></dd></dl></li>"))
    cards = _docs(spark, d).select(F.floor(i / 120).alias("target_id"), F.floor(i % 120 / 50).cast("int").alias("page"), "doc_id", card.alias("card"))
    again = cards.where((i % 120 % 50 == 0) & (i % 120 < 70)).withColumn("page", F.col("page") + 1)
    listed = cards.unionByName(again).groupBy("target_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "card"))), lambda x: x["card"]), "").alias("payload"))
    return payloads.icims(listed.withColumn("tenant", F.lit("t"))).select(*_SHOWN)


_JD = "word " * 60
_ITEMS = [
    ("Acme {n}: Dev: senior", "Dev: senior", "Acme {n}", "EU", f"&lt;p&gt;{_JD}&amp;eacute; {{n}}&lt;/p&gt;", f"Region: EU\n\n{_JD}\u00e9 {{n}}"), ("Thin: x", None, None, "EU", "short {n}", None),
    ("No company {n}", "No company {n}", "", "", f"<![CDATA[<p>{_JD}&mdash;</p>]]>", f"{_JD}\u2014"),
]


@query(f"""SELECT target_id, row_number() OVER (PARTITION BY target_id ORDER BY doc_id) - 1 AS pos, 'u' || doc_id AS url, title, company, description, location FROM (SELECT doc_id, CAST(doc_id // 50 AS VARCHAR) AS target_id, {', '.join(f'{_sql(_columns(_ITEMS, k))} AS {c}' for k, c in ((1, 'title'), (2, 'company'), (3, 'location'), (5, 'description')))} FROM documents) WHERE title IS NOT NULL""")
def s18_rss(spark, d):
    item = F.concat(F.lit("<item><title>"), _case(_columns(_ITEMS, 0)), F.lit("</title><link>u"), _id(), F.lit("</link><region>"), _case(_columns(_ITEMS, 3)), F.lit("</region><description>"), _case(_columns(_ITEMS, 4)), F.lit("</description></item>"))
    feeds = _docs(spark, d).groupBy(F.floor(F.col("doc_id") / 50).cast("string").alias("target_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", item.alias("x")))), lambda x: x["x"]).alias("all"))
    return payloads.rss(feeds.select("target_id", F.concat(F.lit("<rss>"), F.array_join("all", "\n"), F.lit("</rss>")).alias("payload"))).select("target_id", "pos", "url", "title", "company", "description", "location")


_LD = '<script type="application/ld+json">{"@graph": [{"@type": "Thing"}, {"@type": ["JobPosting", "X"], "title": "A{n}", "description": "<p>d &eacute;{n}</p>", "datePosted": "2024-01-02T00", "hiringOrganization": {"name": "Acme"}}]}</script>'
_NEXT = '<script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {"apiData": {"jobPost": {"name": "B{n}", "companyName": "Bee", "createdOn": "2024-03-04T1", "description": {"company": "<i>c</i>", "role": "<b>r{n}</b>"}}}}}}</script>'
_PAGES = [(_LD, "A{n}", "Acme", "d \u00e9{n}", "2024-01-02"), (_NEXT, "B{n}", "Bee", "r{n}\n\nc", "2024-03-04"), ("<p>none {n}</p>", None, None, None, None)]


@query(f"SELECT doc_id, {', '.join(f'{_sql(_columns(_PAGES, k))} AS {c}' for k, c in enumerate(('title', 'company', 'description', 'posted_at'), 1))} FROM documents")
def s24_s25_page_posting(spark, d):
    found = payloads.page_posting(_case(_columns(_PAGES, 0)))
    return _docs(spark, d).select("doc_id", found.alias("p")).select("doc_id", *(F.col(f"p.{c}").alias(c) for c in ("title", "company", "description", "posted_at")))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN trim(repeat('word' || doc_id || ' ', 60)) END AS streamed FROM documents")
def s24_streamed_state(spark, d):
    """The description in a page's streamed state: of a third of the pages; another third name a row that isn't there, the rest are too short."""
    body = F.concat(F.lit("<p>"), F.repeat(F.concat(F.lit("word"), _id(), F.lit(" ")), 60), F.lit("</p>"))
    state = F.concat(F.lit(r'1:{\"job_description\":\"$2a\"}\n'), F.when(F.col("doc_id") % 3 == 1, F.lit("2b")).otherwise(F.lit("2a")), F.lit(":T"), F.lower(F.hex(F.length(body))), F.lit(","), F.when(F.col("doc_id") % 3 == 2, F.lit("<p>short</p>")).otherwise(body))
    html = F.concat(F.lit('<script>self.__next_f.push([1,"'), state, F.lit('"])</script><script>self.__next_f.push([1,"\\n3:x"])</script>'))
    return page_tree.posting_texts(_docs(spark, d).select("doc_id", html.alias("html"))).select("doc_id", F.col("posting.streamed").alias("streamed"))


@query()
def s24_page_text(spark, d):
    """The text of the likeliest element of each page."""
    pages = table(prepare(spark), d, "pages").select("page_id", "html")
    return page_tree.posting_texts(pages).select("page_id", F.md5(F.encode(F.coalesce("posting.longest", F.lit("")), "utf-8")).alias("text_md5"))


@query("SELECT 'f' || doc_id || '.md' AS path, CASE WHEN doc_id % 11 = 1 THEN 'added' WHEN doc_id % 7 = 3 THEN 'gone' ELSE 'changed' END AS change FROM documents WHERE doc_id % 11 = 1 OR doc_id % 7 = 3 OR doc_id % 5 = 0")
def s22_corpus_changes(spark, d):
    """A corpus of a file for each document, stored, then written anew with changes: what the second reload tells; files that only have a new time are none."""
    i = F.col("doc_id")
    name = F.concat(F.lit("d"), (i % 100).cast("string"), F.lit("/f"), _id(), F.lit(".md"))
    before = _docs(spark, d).where(i % 11 != 1).select(name.alias("path"), F.col("text").alias("text"))
    after = _docs(spark, d).where((i % 7 != 3) | (i % 11 == 1)).select(name.alias("path"), F.when((i % 5 == 0) & (i % 11 != 1), F.concat(F.lit("new "), F.coalesce("text", F.lit("")))).otherwise(F.col("text")).alias("text"))
    folder = _folder(spark, "corpus")
    store = Store(spark, f"{folder}/store")
    files.write_files(before, f"{folder}/notes")
    files.reload(store, f"{folder}/notes")
    files.delete_files(spark, f"{folder}/notes")
    files.write_files(after, f"{folder}/notes")
    told = files.reload(store, f"{folder}/notes")
    return told.select(F.substring_index("path", "/", -1).alias("path"), "change")


# Files


_APPLIED = [(" true ", True), ("TRUE", True), ("FALSE", False), ("", False), (None, False)]


@query(f"""SELECT 'csv-import://' || branch AS url, company, branch AS title, platform AS ats_platform, 'applied' AS status, referral, callback, 0 AS ghosted, 0 AS offer, notes FROM (SELECT 'branch' || doc_id AS branch, 'Company, "' || doc_id || '"' AS company, CASE WHEN doc_id % 2 = 0 THEN 'ashby' ELSE 'lever' END AS platform,
 CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS referral, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS callback, CASE WHEN doc_id % 6 = 0 THEN 'two' || chr(10) || 'lines' ELSE '' END AS notes FROM documents WHERE {_sql(_columns(_APPLIED, 1))} AND doc_id % 7 <> 0)""")
def s8_history(spark, d):
    """A history in CSV with quoted cells of several lines, written from documents and imported; a seventh of its addresses are known."""
    i = F.col("doc_id")
    branch = F.concat(F.lit("branch"), _id())
    rows_ = _docs(spark, d).select(
        _case(_columns(_APPLIED, 0)).alias("Applied T/F"), branch.alias("Position (branch)"), F.concat(F.lit('Company, "'), _id(), F.lit('"')).alias("Company"), F.when(i % 2 == 0, "AshbyHQ").otherwise(" Lever").alias("Platform Name"), F.when(i % 3 == 0, "TRUE").alias("Referral"),
        F.when(i % 4 == 0, "true").otherwise("no").alias("Callback T/F"), F.lit(None).cast("string").alias("Ghosted"), F.lit("").alias("Offer"), F.when(i % 6 == 0, "two\nlines").alias("Notes"),
    )
    folder = _folder(spark, "history")
    rows_.write.csv(folder, header=True, quoteAll=True, escape='"')
    known = _docs(spark, d).where(i % 7 == 0).select(F.concat(F.lit("csv-import://"), branch).alias("url"))
    return files.import_history(files.history(spark, folder), known)


_NOTES = [("---\nTitle: T{n}\n---\n", "T{n}"), ("", None)]


@query(f"SELECT 'f' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.txt' END AS path, {_sql(_columns(_NOTES, 1))} AS title, md5('body ' || lang || doc_id) AS body_md5 FROM documents WHERE doc_id % 5 <> 4")
def s20_corpus(spark, d):
    """Notes of a folder of a file a document, in folders below it; files that are no notes are left out."""
    i = F.col("doc_id")
    name = F.concat(F.lit("d"), (i % 10).cast("string"), F.lit("/f"), _id(), F.when(i % 5 == 4, F.lit(".bin")).when(i % 3 == 0, F.lit(".md")).otherwise(F.lit(".txt")))
    folder = _folder(spark, "notes")
    files.write_files(_docs(spark, d).select(name.alias("path"), F.concat(_case(_columns(_NOTES, 0)), F.lit("body "), "lang", _id()).alias("text")), folder)
    read = files.corpus(spark, folder)
    return read.select(F.substring_index("path", "/", -1).alias("path"), F.try_element_at("meta", F.lit("title")).alias("title"), F.md5(F.encode("body", "utf-8")).alias("body_md5"))


@query("SELECT 'f' || doc_id || '.md' AS path, sha256(coalesce(text, '')) AS sha256, strlen(coalesce(text, '')) AS size FROM documents")
def s23_files_with_hash(spark, d):
    """Whole texts read as files, with the hashes of their bytes."""
    folder = _folder(spark, "texts")
    files.write_files(_docs(spark, d).select(F.concat(F.lit("d"), (F.col("doc_id") % 100).cast("string"), F.lit("/f"), _id(), F.lit(".md")).alias("path"), "text"), folder)
    return files.text_file(spark, folder).select(F.substring_index("path", "/", -1).alias("path"), "sha256", F.octet_length("text").cast("long").alias("size"))


@query("""SELECT 'Company ' || doc_id % 97 AS company, 'T "' || doc_id || '", x' AS title, 'u' || doc_id AS url, CASE WHEN doc_id % 3 = 0 THEN 'true' ELSE 'false' END AS keep, CASE doc_id % 3 WHEN 0 THEN 'kept' WHEN 1 THEN 'gates' ELSE 'rules' END AS stage, 'because' AS reason,
 CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 50 AS VARCHAR) ELSE '' END AS fit_sketch, CASE WHEN doc_id % 3 = 1 THEN 'visa: must | hold ' || doc_id ELSE '' END AS gates FROM documents""")
def m12_report_file(spark, d):
    """The report's file of all decisions, written and read again."""
    i = F.col("doc_id")
    gate = F.array(F.struct(F.lit("visa").alias("gate"), F.concat(F.lit("must | hold "), _id()).alias("evidence")))
    decisions = _docs(spark, d).select(
        i.alias("pos"), F.concat(F.lit("Company "), (i % 97).cast("string")).alias("company"), F.concat(F.lit('T "'), _id(), F.lit('", x')).alias("title"), F.concat(F.lit("u"), _id()).alias("url"), (i % 3 == 0).alias("keep"),
        F.when(i % 3 == 0, "kept").when(i % 3 == 1, "gates").otherwise("rules").alias("stage"), F.lit("because").alias("reason"), F.when(i % 2 == 0, (i % 50).cast("int")).alias("fit_sketch"), F.when(i % 3 == 1, gate).alias("gate_failures"),
    )
    folder = _folder(spark, "reports")
    report.write_reports(decisions, folder, "x", problems=spark.createDataFrame([("feed", "timed out")], "source string, message string"))
    return spark.read.csv(f"{folder}/prescreen-x", header=True, escape='"').na.fill("")
