"""A forum's monthly hiring thread as postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import best_url, company_and_title, looks_like_posting, strip, strip_html_paragraphs
from larkspur.session import once

# How the thread's title begins, and what its sister threads have in theirs.
THREAD, NOT_THREAD = "ask hn: who is hiring?", "freelance"
MOST = 500


def latest_thread(stories: DataFrame) -> DataFrame:
    """The newest hiring thread of stories (story_id, title, created_at): one row, or none."""
    title = F.lower(F.coalesce("title", F.lit("")))
    own = stories.where(F.startswith(title, F.lit(THREAD)) & ~F.contains(title, F.lit(NOT_THREAD)))
    return own.orderBy(F.desc("created_at"), F.desc("story_id")).limit(1)


def thread_postings(thread: DataFrame, comments: DataFrame, most: int = MOST) -> DataFrame:
    """Postings among the thread's top-level comments (comment_id, parent_id, comment_text, created_at), in their order, up to a limit.

    A comment's first line names company and title; without a company or an address, or without the looks of a posting, it is none.
    """
    own = comments.join(F.broadcast(thread.limit(1).select(F.col("story_id").alias("parent_id"), F.col("title").alias("_thread"))), "parent_id")
    read = once(own, description=strip_html_paragraphs(F.col("comment_text")))
    first = F.get(F.filter(F.split("description", "\\R"), lambda x: strip(x) != ""), 0)
    read = once(read, _parts=company_and_title(first), url=best_url(F.col("description"))).withColumns({"company": F.col("_parts.company"), "title": F.col("_parts.title")})
    good = read.where(F.col("url").isNotNull() & (F.col("company") != "") & looks_like_posting(F.col("company"), F.col("title"), F.col("description")))
    return good.orderBy("comment_id").limit(most).select(
        "comment_id", "url", "title", "company", "description", F.concat(F.lit("hn:"), F.coalesce("_thread", F.lit("who-is-hiring"))).alias("source"),
        F.nullif(F.substring(F.coalesce(F.col("created_at").cast("string"), F.lit("")), 1, 10), F.lit("")).alias("posted_at"),
    )


def transcript(messages: DataFrame, session: str = "session_id", order: str = "turn") -> DataFrame:
    """messages with their place in their session."""
    return messages.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(order)).cast("long"))
