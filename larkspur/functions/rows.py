"""Derived columns of postings, codes, sessions and reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import slug

# Fixed values.
PLATFORM_ALIASES = {"ashbyhq": "ashby"}
TENANT_PREFIXES = ["careers", "career", "jobs", "recruiting", "talent", "apply"]
BADGES = [(80, "#28a745"), (60, "#17a2b8"), (40, "#ffc107"), (float("-inf"), "#dc3545")]
#: Dollars per million tokens, by price list entry: input, output. Reads of a cache cost a tenth of the input, writes five quarters.
CACHE_READ, CACHE_WRITE = 0.1, 1.25


def recommendation(fit: Column) -> Column:
    return F.when(fit.isNull(), F.lit(None).cast("string")).when(fit >= 80, "strong_match").when(fit >= 60, "consider").when(fit >= 40, "weak_match").otherwise("skip")


def platform_label(platform: Column) -> Column:
    low = F.lower(F.trim(platform))
    chain = low
    for old, new in PLATFORM_ALIASES.items():
        chain = F.when(low == old, F.lit(new)).otherwise(chain)
    return chain


def branch_name(company: Column, row_id: Column, day: Column) -> Column:
    return F.concat_ws("-", slug(company), row_id.cast("string"), F.date_format(day, "yyyyMMdd"))


def titled(text: Column) -> Column:
    """Each run of letters with a capital first, the rest small."""
    runs = F.regexp_extract_all(text, F.lit("[\\p{L}]+|[^\\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def _capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 20)))


def display_name(identifier: Column, platform: Column, url: Column) -> Column:
    """A company's name from what identifies its board; from the host of the address where nothing does."""
    has = lambda k: F.nullif(F.try_element_at(identifier, F.lit(k)), F.lit(""))
    board = F.coalesce(*(has(k) for k in ("board", "company", "org", "slug")))
    tenant = F.regexp_replace(has("tenant"), f"^({'|'.join(TENANT_PREFIXES)})-", "")
    host = F.nullif(F.regexp_extract(url, "https?://([^/]+)", 1), F.lit(""))
    named = F.coalesce(
        titled(F.regexp_replace(board, "[-_]", " ")), titled(F.replace(tenant, F.lit("-"), F.lit(" "))),
        F.when(platform == "workday", _capital(F.substring_index(has("host"), ".", 1))), F.lit("Unnamed"),
    )
    return F.when(F.coalesce(F.size(identifier), F.lit(0)) <= 0, _capital(F.substring_index(F.coalesce(host, F.lit("Unnamed")), ".", 1))).otherwise(named)


def decode_list(json: Column) -> Column:
    """A JSON array of strings; empty where it is malformed."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def normalised_analysis(analysis: Column) -> Column:
    """summary, strengths, gaps and recommendation of an analysis in JSON, under its newer names or its older ones; what is null or empty gives way."""
    text = lambda k: F.nullif(F.get_json_object(analysis, f"$.{k}"), F.lit(""))
    items = lambda k: F.when(F.size(decode_list(F.get_json_object(analysis, f"$.{k}"))) > 0, decode_list(F.get_json_object(analysis, f"$.{k}")))
    none = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(text("candidate_explanation"), text("summary"), F.lit("")).alias("summary"), F.coalesce(items("candidate_strengths"), items("strengths"), none).alias("strengths"),
        F.coalesce(items("candidate_deficiencies"), items("gaps"), none).alias("gaps"), F.get_json_object(analysis, "$.recommendation").alias("recommendation"),
    )


def gates_text(gates: Column) -> Column:
    return F.array_join(F.transform(gates, lambda g: F.concat(g["gate"], F.lit(": "), F.substring(F.coalesce(g["evidence"], F.lit("")), 1, 120))), "; ")


def badge_color(score: Column) -> Column:
    """The colour of a score's bucket; null where there is no score."""
    chain = F.when(score.isNull(), F.lit(None).cast("string"))
    for least, color in BADGES:
        chain = chain.when(score >= least, F.lit(color))
    return chain


def cron_hours(per_day: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), per_day.cast("int") - 1), lambda i: F.floor(i * 24 / per_day).cast("int"))


def token_cost(usage: dict[str, Column], price_in: Column, price_out: Column) -> Column:
    """Dollars of an exchange: usage has input, cache_read, cache_write and output tokens; missing ones are 0."""
    u = {k: F.coalesce(usage[k], F.lit(0)) for k in ("input", "cache_read", "cache_write", "output")}
    return (u["input"] * price_in + u["cache_read"] * price_in * CACHE_READ + u["cache_write"] * price_in * CACHE_WRITE + u["output"] * price_out) / 1_000_000


def session_key(surface: Column, code: Column, session: Column, at: Column) -> Column:
    return (
        F.when(surface == "web", F.concat_ws(":", F.lit("web"), session))
        .when(surface == "mcp", F.concat_ws(":", F.lit("mcp"), code, session))
        .otherwise(F.concat_ws(":", F.lit("fetch"), code, F.date_format(at, "yyyy-MM-dd")))
    )
