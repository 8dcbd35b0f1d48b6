"""Boards that are watched: what an address resolves to, what is watched already, what is still listed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.rows import display_name
from larkspur.functions.urls import board_candidates, detect_platform, embedded_board, netloc, parameter, path
from larkspur.session import once, saved


def vanity_boards(rows: DataFrame, postings: DataFrame, url: str = "careers_url") -> DataFrame:
    """rows with the board that an address on a company's own host stands for, where one of the boards the host's name suggests has the posting.

    postings: board and job_id of postings that are known to exist. Earlier suggestions win; hosts of the board's own platform are none of these.
    """
    host = F.lower(F.regexp_replace(F.regexp_replace(netloc(F.col(url)), "^.*@", ""), ":\\d+$", ""))
    job = F.coalesce(parameter(F.col(url), "gh_jid"), F.nullif(F.regexp_extract(path(F.col(url)), "/(\\d{5,})/?$", 1), F.lit("")))
    own = (host == "greenhouse.io") | F.endswith(host, F.lit(".greenhouse.io"))
    asked = rows.where(job.isNotNull() & ~own).select(url, job.alias("job_id"), F.posexplode(board_candidates(host)).alias("_at", "board"))
    found = asked.join(postings.select("board", F.col("job_id").cast("string").alias("job_id")).distinct(), ["board", "job_id"], "left_semi")
    return rows.join(found.groupBy(url).agg(F.min_by("board", "_at").alias("vanity_board")), url, "left")


def register(rows: DataFrame, current: DataFrame, *, postings: DataFrame, pages: DataFrame, boards: DataFrame) -> DataFrame:
    """rows (careers_url, name) with outcome, platform, identifier, the canonical careers_url and the name of the target each makes.

    pages: careers_url and html of addresses that name no board. boards: platform, board and name of boards known to exist. Outcomes: missing, unsupported, unverified, existing (watched already, or asked for before in rows), added.
    """
    given = rows.withColumn("careers_url", F.trim(F.coalesce("careers_url", F.lit("")))).withColumn("_asked", F.col("careers_url"))
    known = vanity_boards(given, postings).join(pages.select("careers_url", embedded_board(F.col("html")).alias("_embedded")).dropDuplicates(["careers_url"]), "careers_url", "left")
    # What an address names is a large expression, which must not be copied into every use of it.
    known = once(known, _direct=detect_platform(F.col("careers_url")))
    other = F.col("_direct.platform") == "other"
    resolved = F.when(other & F.col("vanity_board").isNotNull(), F.concat(F.lit("https://boards.greenhouse.io/"), F.col("vanity_board"))).when(other & F.col("_embedded").isNotNull(), F.col("_embedded")).otherwise(F.col("careers_url"))
    known = once(known, careers_url=resolved)
    known = once(known, _found=detect_platform(F.col("careers_url"))).withColumns({"platform": F.col("_found.platform"), "identifier": F.col("_found.identifier")})
    at = lambda k: F.try_element_at("identifier", F.lit(k))
    board = F.coalesce(at("board"), at("slug"), at("tenant"), at("org"), at("company"), F.concat_ws("/", at("host"), at("site")))
    canonical = (
        F.when(F.col("platform") == "icims", F.concat(F.lit("https://"), at("tenant"), F.lit(".icims.com/jobs/search?ss=1")))
        .when(F.col("platform") == "rippling", F.concat(F.lit("https://ats.rippling.com/"), at("slug"), F.lit("/jobs")))
        .when(F.col("platform") == "workday", F.concat(F.lit("https://"), F.concat_ws("/", at("host"), F.nullif(at("lang"), F.lit("")), at("site"))))
        .otherwise(F.col("careers_url"))
    )
    known = known.withColumn("_board", board).join(boards.select("platform", F.col("board").alias("_board"), F.col("name").alias("_board_name"), F.lit(True).alias("_real")).dropDuplicates(["platform", "_board"]), ["platform", "_board"], "left")
    known = known.withColumn("careers_url", F.when(F.col("_asked") != "", canonical).otherwise(F.col("careers_url")))
    checked = F.col("platform").isin("greenhouse", "icims", "rippling", "workday")
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.when(F.col("platform") == "greenhouse", F.nullif("_board_name", F.lit(""))), display_name(F.col("identifier"), F.col("platform"), F.col("careers_url")))
    outcome = F.when(F.col("_asked") == "", "missing").when(F.col("platform") == "other", "unsupported").when(checked & F.col("_real").isNull(), "unverified").otherwise("ok")
    judged = saved(known.withColumns({"name": name, "outcome": outcome}).select("pos", "outcome", "platform", "identifier", "careers_url", "name"))
    taken = current.select("careers_url", F.lit(True).alias("_taken")).distinct()
    first = judged.where(F.col("outcome") == "ok").groupBy("careers_url").agg(F.min("pos").alias("_first"))
    both = judged.join(taken, "careers_url", "left").join(first, "careers_url", "left")
    final = F.when(F.col("outcome") != "ok", F.col("outcome")).when(F.col("_taken").isNotNull() | (F.col("pos") > F.col("_first")), "existing").otherwise("added")
    return both.select("pos", final.alias("outcome"), "platform", "identifier", "careers_url", "name")


def prefixes(url: Column) -> Column:
    """An address and all its beginnings that end before a slash."""
    parts = F.split(url, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def watched_already(rows: DataFrame, targets: DataFrame, url: str = "careers_url") -> DataFrame:
    """Of rows, those whose address, or a beginning of it before a slash, is a target's. Prefixes are joined by equality."""
    stored = targets.where(F.coalesce("careers_url", F.lit("")) != "").select(F.col("careers_url").alias("_prefix")).distinct()
    hits = rows.select(url, F.explode(prefixes(F.col(url))).alias("_prefix")).join(stored, "_prefix", "left_semi").select(url).distinct()
    return rows.join(hits, url, "left_semi")


def unlisted(rows: DataFrame, listed: DataFrame, key: str = "posting") -> DataFrame:
    """Of rows, those whose posting the live board no longer lists; cases don't matter."""
    live = listed.select(F.lower(key).alias("_key")).distinct()
    return rows.withColumn("_key", F.lower(key)).join(live, "_key", "left_anti").drop("_key")
