"""Captured payloads of job boards and feeds as tables of postings.

Each reader takes rows of (target_id, payload) and returns target_id, pos, url, title, description,
posted_at and location; pos is the order in which a poll walks a board. Boards that tell dates are
read newest first, all others in their own order. Malformed payloads have no postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import strip, strip_html, strip_html_paragraphs, unescape
from larkspur.session import once

POSTING = ["target_id", "pos", "url", "title", "description", "posted_at", "location"]
MIN_DESCRIPTION = 200
#: Postings on a page, and pages that are read at most; rows of a listing's full page.
PAGE_SIZE, MAX_PAGES, FULL_PAGE = 20, 10, 50


def _filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def _exploded(payloads: DataFrame, schema: str, path: str | None = None) -> DataFrame:
    """target_id, at (the place in the payload) and j, for each element of the payload's array."""
    parsed = F.from_json("payload", schema)
    return payloads.select(*(c for c in payloads.columns if c != "payload"), F.posexplode(parsed[path] if path else parsed).alias("at", "j"))


def _placed(rows: DataFrame, *order: Column) -> Column:
    return (F.row_number().over(Window.partitionBy("target_id").orderBy(*order)) - 1).cast("long")


def greenhouse(payloads: DataFrame) -> DataFrame:
    schema = "jobs array<struct<absolute_url:string,title:string,content:string,first_published:string,updated_at:string,location:struct<name:string>>>"
    rows = _exploded(payloads, schema, "jobs")
    pos = _placed(rows, F.desc(F.coalesce("j.first_published", F.lit(""))), F.col("at"))
    posted = F.substring(_filled(F.col("j.first_published"), F.col("j.updated_at")), 1, 10)
    return rows.select("target_id", pos.alias("pos"), F.col("j.absolute_url").alias("url"), "j.title", strip_html(F.col("j.content")).alias("description"), posted.alias("posted_at"), F.coalesce("j.location.name", F.lit("")).alias("location"))


def ashby(payloads: DataFrame) -> DataFrame:
    """Unlisted postings are left out; a posting has all its locations."""
    schema = "jobs array<struct<jobUrl:string,title:string,descriptionPlain:string,descriptionHtml:string,publishedAt:string,isListed:boolean,location:string,secondaryLocations:array<string>>>"
    rows = _exploded(payloads, schema, "jobs").where(~F.col("j.isListed").eqNullSafe(F.lit(False)))
    pos = _placed(rows, F.desc(F.coalesce("j.publishedAt", F.lit(""))), F.col("at"))
    places = F.filter(F.concat(F.array("j.location"), F.coalesce("j.secondaryLocations", F.array().cast("array<string>"))), lambda p: F.coalesce(p, F.lit("")) != "")
    text = F.coalesce(F.nullif("j.descriptionPlain", F.lit("")), strip_html(F.col("j.descriptionHtml")))
    return rows.select("target_id", pos.alias("pos"), F.col("j.jobUrl").alias("url"), "j.title", text.alias("description"), F.nullif(F.substring("j.publishedAt", 1, 10), F.lit("")).alias("posted_at"), F.array_join(places, ", ").alias("location"))


def lever(payloads: DataFrame) -> DataFrame:
    schema = "array<struct<hostedUrl:string,text:string,descriptionPlain:string,descriptionBodyPlain:string,createdAt:double,categories:struct<location:string>,country:string>>"
    rows = _exploded(payloads, schema)
    pos = _placed(rows, F.desc(F.coalesce("j.createdAt", F.lit(0.0))), F.col("at"))
    parts = F.filter(F.array("j.descriptionPlain", "j.descriptionBodyPlain"), lambda p: F.coalesce(p, F.lit("")) != "")
    day = F.when(F.col("j.createdAt") > 0, F.date_format(F.timestamp_millis(F.col("j.createdAt").cast("long")), "yyyy-MM-dd"))
    place = F.coalesce(_filled(F.col("j.categories.location"), F.col("j.country")), F.lit(""))
    return rows.select("target_id", pos.alias("pos"), F.col("j.hostedUrl").alias("url"), F.col("j.text").alias("title"), strip(F.array_join(parts, "\n\n")).alias("description"), day.alias("posted_at"), place.alias("location"))


def workday(pages: DataFrame) -> DataFrame:
    """pages: target_id, host, site, lang, page (from 0) and payload. The first page tells how many postings there are; reading ends there, at an empty page, or at the last page allowed."""
    parsed = pages.withColumn("p", F.from_json("payload", "jobPostings array<struct<externalPath:string,title:string,locationsText:string,startDate:string>>, total long"))
    total = F.max(F.when(F.col("page") == 0, F.coalesce("p.total", F.lit(0)))).over(Window.partitionBy("target_id"))
    empty = F.coalesce(F.size("p.jobPostings"), F.lit(0)) <= 0
    stopped = F.max(empty.cast("int")).over(Window.partitionBy("target_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    read = parsed.withColumns({"total": total, "stopped": stopped}).where((F.col("stopped") == 0) & (F.col("page") < MAX_PAGES) & ((F.col("page") == 0) | (F.coalesce("total", F.lit(0)) == 0) | (F.col("page") * PAGE_SIZE < F.col("total"))))
    rows = read.select("target_id", "host", "site", "lang", "page", F.posexplode("p.jobPostings").alias("at", "j")).where(F.coalesce("j.externalPath", F.lit("")) != "")
    prefix = F.concat(F.when(F.coalesce("lang", F.lit("")) != "", F.concat("lang", F.lit("/"))).otherwise(""), F.col("site"))
    url = F.concat(F.lit("https://"), F.col("host"), F.lit("/"), prefix, F.when(F.startswith(F.col("j.externalPath"), F.lit("/")), F.lit("")).otherwise("/"), F.col("j.externalPath"))
    day = F.when(F.rlike("j.startDate", F.lit("^.{4}-.{5}")), F.substring("j.startDate", 1, 10))
    return rows.select("target_id", _placed(rows, F.col("page"), F.col("at")).alias("pos"), url.alias("url"), "j.title", F.lit(None).cast("string").alias("description"), day.alias("posted_at"), F.coalesce("j.locationsText", F.lit("")).alias("location"))


def rippling(payloads: DataFrame) -> DataFrame:
    """A place of work is a text, or an object with a label or a name; values of other shapes name no place.

    Postings are read as variants, so each keeps the shape that it was sent with and no shape is guessed for all of them.
    """
    kept = [c for c in payloads.columns if c != "payload"]
    each = payloads.select(*kept, F.posexplode(F.try_variant_get(F.try_parse_json("payload"), "$", "array<variant>")).alias("at", "j"))
    text = lambda v, path: F.try_variant_get(v, path, "string")
    place = F.try_variant_get(F.col("j"), "$.workLocation", "variant")
    shape = F.schema_of_variant(place)
    where = F.when(shape == "STRING", text(place, "$")).when(F.startswith(shape, F.lit("OBJECT")), _filled(text(place, "$.label"), text(place, "$.name")))
    rows = once(each, url=text(F.col("j"), "$.url"), title=text(F.col("j"), "$.name"), location=F.coalesce(where, F.lit(""))).where(F.coalesce("url", F.lit("")) != "")
    return rows.select("target_id", _placed(rows, F.col("at")).alias("pos"), "url", "title", F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("posted_at"), "location")


def shapes(payloads: DataFrame, path: str) -> DataFrame:
    """The shape of what stands at a path of each payload's postings, and how many have it; and one shape that holds them all (a null `shape`).

    A path that a posting lacks has no shape and is left out. Malformed payloads have no postings.
    """
    each = payloads.select(F.explode(F.try_variant_get(F.try_parse_json("payload"), "$", "array<variant>")).alias("j")).select(F.try_variant_get("j", path, "variant").alias("v")).where("v IS NOT NULL")
    own = each.groupBy(F.schema_of_variant("v").alias("shape")).agg(F.count("*").alias("n"))
    return own.select("shape", "n", F.lit(None).cast("string").alias("common")).unionByName(each.agg(F.count("*").alias("n"), F.schema_of_variant_agg("v").alias("common")).withColumn("shape", F.lit(None).cast("string")).where("n > 0"))


def _behind_first(parts: Column) -> Column:
    return F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))


def icims(pages: DataFrame, marker: str = "iCIMS_JobCardItem") -> DataFrame:
    """pages: target_id, tenant, page (from 0) and payload, the HTML of a listing. An id counts where it comes first. Reading ends behind a page that isn't full or brings no new id, and after ten."""
    blocks = pages.select("target_id", "tenant", "page", F.posexplode(_behind_first(F.split("payload", f"<[^>]*{marker}[^>]*>"))).alias("at", "block"))
    link = lambda k: F.nullif(F.regexp_extract("block", "/jobs/(\\d+)/([^/\"?]+)/job", k), F.lit(""))
    title = F.nullif(F.regexp_extract("block", "title=\"\\d+ - ([^\"]*)\"", 1), F.lit(""))
    place = F.regexp_extract("block", "(?is)<dt[^>]*>.*?location.*?</dt>\\s*<dd[^>]*>\\s*<span[^>]*>(.*?)</span>", 1)
    rows = blocks.select("*", link(1).alias("job"), link(2).alias("slug"), title.alias("titled"), place.alias("place")).where(F.col("job").isNotNull())
    marked = rows.where(F.col("page") < MAX_PAGES).withColumn("n", F.row_number().over(Window.partitionBy("target_id", "job").orderBy("page", "at")))
    sizes = marked.groupBy("target_id", "page").agg(F.count("*").alias("rows"), F.sum((F.col("n") == 1).cast("int")).alias("fresh"))
    ended = F.max(((F.col("rows") < FULL_PAGE) | (F.col("fresh") == 0)).cast("int")).over(Window.partitionBy("target_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    read = sizes.withColumn("ended", F.coalesce(ended, F.lit(0))).where(F.col("ended") == 0).select("target_id", "page")
    first = marked.where(F.col("n") == 1).join(read, ["target_id", "page"])
    url = F.concat(F.lit("https://"), F.col("tenant"), F.lit(".icims.com/jobs/"), F.col("job"), F.lit("/"), F.col("slug"), F.lit("/job"))
    named = F.coalesce(strip(unescape(F.col("titled"))), F.replace("slug", F.lit("-"), F.lit(" ")))
    return first.select("target_id", _placed(first, F.col("page"), F.col("at")).alias("pos"), url.alias("url"), named.alias("title"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("posted_at"), strip(unescape(F.col("place"))).alias("location"))


def rss(feeds: DataFrame) -> DataFrame:
    """feeds: target_id (the feed's name) and payload, its XML. Thin descriptions are dropped before the region is added."""
    items = feeds.select("target_id", F.posexplode(F.regexp_extract_all("payload", F.lit("(?s)<item>(.*?)</item>"), F.lit(1))).alias("at", "item"))

    def element(name: str) -> Column:
        raw = F.regexp_extract("item", f"(?s)<{name}>(.*?)</{name}>", 1)
        plain = F.regexp_extract(raw, "(?s)^\\s*<!\\[CDATA\\[(.*?)\\]\\]>\\s*$", 1)
        return strip(F.when(plain != "", plain).otherwise(unescape(raw)))

    rows = items.select("target_id", "at", element("title").alias("full"), element("link").alias("url"), element("region").alias("region"), strip_html_paragraphs(element("description")).alias("jd"))
    rows = rows.where((F.col("url") != "") & (F.length("jd") >= MIN_DESCRIPTION))
    split = F.contains("full", F.lit(":"))
    title = F.when(split, strip(F.substring("full", F.instr("full", ":") + 1, F.length("full")))).otherwise(F.col("full"))
    body = F.when(F.col("region") != "", F.concat(F.lit("Region: "), F.col("region"), F.lit("\n\n"), F.col("jd"))).otherwise(F.col("jd"))
    company = F.when(split, strip(F.substring_index("full", ":", 1))).otherwise("")
    return rows.select("target_id", _placed(rows, F.col("at")).alias("pos"), "url", F.coalesce(F.nullif(title, F.lit("")), "full").alias("title"), company.alias("company"), body.alias("description"), F.col("region").alias("location"))


#: Readers of payloads that are one for each target. Listings that come in pages have readers of their own: workday, icims.
ADAPTERS = {"greenhouse": greenhouse, "ashby": ashby, "lever": lever, "rippling": rippling}


def postings(captured: DataFrame) -> DataFrame:
    """Postings of payloads (target_id, platform, payload), each read by its platform's adapter; platforms without one have none."""
    read = [reader(captured.where(F.col("platform") == name).drop("platform")).select(*POSTING).withColumn("platform", F.lit(name)) for name, reader in ADAPTERS.items()]
    out = read[0]
    for more in read[1:]:
        out = out.unionByName(more)
    return out


def posting_json(html: Column) -> Column:
    """The first JSON-LD object of type JobPosting that a page has, at its top, in its list or in its graph, as JSON."""
    scripts = F.regexp_extract_all(html, F.lit("(?is)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>"), F.lit(1))
    several = lambda s: F.coalesce(F.from_json(s, "array<string>"), F.array().cast("array<string>"))
    each = F.flatten(F.transform(scripts, lambda s: F.concat(F.when(F.startswith(F.ltrim(s), F.lit("[")), several(s)).otherwise(F.array(s)), several(F.get_json_object(s, "$['@graph']")))))
    kind = lambda s: F.get_json_object(s, "$['@type']")
    return F.get(F.filter(each, lambda s: (kind(s) == "JobPosting") | F.contains(kind(s), F.lit('"JobPosting"'))), 0)


def page_posting(html: Column) -> Column:
    """title, company, description and posted_at of a page: from its JSON-LD, else from the state that its script carries."""
    ld = posting_json(html)
    state = F.get_json_object(F.regexp_extract(html, "(?is)<script[^>]*id=\"__NEXT_DATA__\"[^>]*>(.*?)</script>", 1), "$.props.pageProps.apiData.jobPost")
    of = lambda x, path: F.nullif(F.get_json_object(x, path), F.lit(""))
    flat = F.array_join(F.filter(F.transform(F.array(of(state, "$.description.role"), of(state, "$.description.company")), strip_html), lambda p: p != ""), "\n\n")
    return F.struct(
        F.coalesce(of(ld, "$.title"), of(state, "$.name")).alias("title"),
        F.coalesce(of(ld, "$.hiringOrganization.name"), of(state, "$.companyName")).alias("company"),
        F.when(ld.isNotNull(), strip_html(of(ld, "$.description"))).otherwise(F.nullif(flat, F.lit(""))).alias("description"),
        F.substring(F.coalesce(of(ld, "$.datePosted"), of(state, "$.createdOn")), 1, 10).alias("posted_at"),
    )
