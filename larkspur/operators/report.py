"""The report on a night's decisions: rows, orders, what the gates dropped, and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.rows import gates_text

from .order import numbered

# Columns of the file that other programs read.
FIELDS = ["company", "title", "url", "keep", "stage", "reason", "fit_sketch", "gates"]
#: Gate drops that are listed, and companies worth a look.
GATE_DROPS, COMPANIES = 40, 25
#: Rows of the summary's other lists.
LISTED = 50


def report_rows(decisions: DataFrame) -> DataFrame:
    """Decisions as flat rows; the quotes of gates are cut at 120 characters."""
    return decisions.withColumn("gates", gates_text(F.coalesce("gate_failures", F.array().cast(decisions.schema["gate_failures"].dataType))))


def ordered(decisions: DataFrame) -> DataFrame:
    """decisions with their place: kept ones first, then by company, as they came."""
    return numbered(decisions, F.desc("keep"), F.col("company"), F.col("pos"))


def kept_by_sketch(decisions: DataFrame) -> DataFrame:
    """Kept decisions with their place, the best sketch first; one that is missing counts as 0."""
    return numbered(decisions.where("keep"), F.desc(F.coalesce("fit_sketch", F.lit(0))), F.col("pos"))


def gate_drops(decisions: DataFrame, n: int = GATE_DROPS) -> DataFrame:
    """The first decisions dropped on gates, each with its first gate."""
    dropped = decisions.where(~F.col("keep") & (F.col("stage") == "gates")).orderBy("pos").limit(n)
    gate = F.get("gate_failures", 0)
    evidence = F.substring(F.replace(F.coalesce(gate["evidence"], F.lit("")), F.lit("|"), F.lit("\\|")), 1, 160)
    return dropped.where(gate.isNotNull()).select("pos", "company", "title", gate["gate"].alias("gate"), evidence.alias("evidence"))


def with_sources(decisions: DataFrame, postings: DataFrame) -> DataFrame:
    """decisions with description, source and posted_at of the posting of their address; of several the last counts."""
    last = postings.groupBy("url").agg(*(F.max_by(c, "pos").alias(c) for c in ("description", "source", "posted_at")))
    return decisions.join(last, "url", "left").withColumn("source", F.coalesce("source", F.lit("discovery")))


def action_summary(rows: DataFrame, action: str = "action") -> DataFrame:
    """Counts of actions with their place by name."""
    counts = rows.groupBy(action).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(action)).cast("long"))


def _cell(value) -> str:
    return "" if value is None else str(value).replace("|", "\\|").replace("\n", " ")


def _section(name: str, head: tuple[str, ...], rows: list, more: int = 0) -> list[str]:
    """A heading and a table under it, and how many rows it leaves to the CSV; nothing where there are no rows."""
    if not rows:
        return []
    line = lambda cells: "| " + " | ".join(map(_cell, cells)) + " |"
    return ["", f"## {name}", "", line(head), line("-" * 3 for _ in head), *map(line, rows), *(["", f"({more} more in the CSV.)"] if more > 0 else [])]


def write_reports(decisions: DataFrame, folder: str, stamp: str, *, scored: DataFrame | None = None, problems: DataFrame | None = None, dry_run: bool = False) -> str:
    """A CSV folder of all decisions in order, and a summary in Markdown beside it; gives the summary.

    scored: rank, score, company and title of what was scored in the run; problems: source and message of what could not be fetched.
    The summary is made of counts and of lists whose lengths are fixed (`LISTED`, `GATE_DROPS`, `COMPANIES`), each telling how much it leaves out;
    all decisions stand in the CSV. Postings that a model failed on are kept, but marked, as nobody has judged them. Nulls are empty cells.
    """
    rows = ordered(report_rows(decisions))
    rows.orderBy("place").select(FIELDS).write.csv(f"{folder}/prescreen-{stamp}", header=True, quoteAll=True, escape='"')
    counts = decisions.groupBy("stage").agg(F.count("*").alias("n"), F.sum(F.col("keep").cast("long")).alias("kept")).orderBy("stage").collect()
    total, kept = sum(r.n for r in counts), sum(r.kept or 0 for r in counts)
    lines = [f"# Postings screened, {stamp}", "", f"{kept} of {total} postings go on." + (" Dry run: none was sent to be scored." if dry_run else "")]
    lines += _section("By stage", ("stage", "goes on", "ends there"), [(r.stage, r.kept or 0, r.n - (r.kept or 0)) for r in counts])
    if scored is not None and not dry_run:
        best = scored.orderBy(F.desc(F.coalesce("rank", F.lit(0))), "company", "title").limit(LISTED).collect()
        lines += _section("Scores", ("company", "title", "score", "rank"), [(r.company, r.title, r.score, r["rank"]) for r in best], scored.count() - len(best))
    judged = F.when(F.col("stage") == "error", F.lit("not judged")).otherwise(F.coalesce(F.col("fit_sketch").cast("string"), F.lit("none")))
    first = decisions.where("keep").withColumn("_sketch", judged).orderBy(F.desc(F.coalesce("fit_sketch", F.lit(0))), "pos").limit(LISTED).collect()
    lines += _section("Going on, best sketch first", ("company", "title", "sketch", "address"), [(r.company, r.title, r["_sketch"], r.url) for r in first], kept - len(first))
    drops = gate_drops(decisions).orderBy("pos").collect()
    lines += _section("Ended at a gate (worth a second look)", ("gate", "company", "title", "because"), [(r.gate, r.company, r.title, r.evidence.replace("\\|", "|")) for r in drops])
    top = decisions.where("keep").groupBy("company").agg(F.count("*").alias("n"), F.min("pos").alias("first")).orderBy(F.desc("n"), "first").limit(COMPANIES).collect()
    lines += _section("Companies by postings that go on", ("postings", "company"), [(r.n, r.company) for r in top])
    if problems is not None:
        failed = problems.where(F.col("message").isNotNull()).orderBy("source", "message").limit(LISTED).collect()
        lines += _section("What failed", ("source", "message"), [(r.source, r.message) for r in failed], problems.where(F.col("message").isNotNull()).count() - len(failed))
    text = "\n".join([*lines, ""])
    decisions.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/summary-{stamp}")
    return text
