"""The report sink, and readers of single files."""

import csv
import hashlib

from larkspur.functions.prompts import ANSWER, answer_schema
from larkspur.operators.report import FIELDS, write_reports
from larkspur.sources import files

GATES = "array<struct<gate:string,evidence:string>>"


def test_write_reports(spark, tmp_path):
    rows = [
        (1, "B", "T1", "u1", True, "kept", "fit sketch 50", 50, []), (2, "A", "T2", "u2", True, "error", "model, \"down\"", None, None),
        (3, "C", "T3", "u3", False, "gates", "gate: visa", 40, [("visa", "must | hold"), ("pay", "low")]), (4, "A", "T4", "u4", False, "rules", "no title", None, []),
    ]
    decisions = spark.createDataFrame(rows, f"pos long, company string, title string, url string, keep boolean, stage string, reason string, fit_sketch int, gate_failures {GATES}")
    scored = spark.createDataFrame([(12.5, 80, "B", "T1"), (None, 7, "A", "a|b"), (90.0, 60, "A", "T2")], "rank double, score int, company string, title string")
    problems = spark.createDataFrame([("feed", "timed out"), ("board", None)], "source string, message string")
    text = write_reports(decisions, str(tmp_path / "out"), "2024-01-31", scored=scored, problems=problems)
    assert "2 of 4 postings go on." in text and "| rules | 0 | 1 |" in text and "| visa | C | T3 | must \\| hold |" in text and text.index("| 1 | A |") > text.index("| 1 | B |")
    assert text.index("| A | T2 | 60 | 90.0 |") < text.index("| B | T1 | 80 | 12.5 |") < text.index("| A | a\\|b | 7 |  |")
    assert "| A | T2 | not judged | u2 |" in text and "| feed | timed out |" in text and "board" not in text
    dry = write_reports(decisions, str(tmp_path / "dry"), "x", scored=scored, dry_run=True)
    assert "Dry run" in dry and "## Scores" not in dry
    many = decisions.where("pos = 1").crossJoin(spark.range(60).withColumnRenamed("id", "k"))
    assert "(10 more in the CSV.)" in write_reports(many, str(tmp_path / "many"), "x")
    parts = sorted((tmp_path / "out" / "prescreen-2024-01-31").glob("part-*.csv"))
    read = [r for p in parts for r in csv.DictReader(p.open())]
    assert [r["url"] for r in read] == ["u2", "u1", "u4", "u3"] and list(read[0]) == FIELDS
    assert read[0]["reason"] == 'model, "down"' and read[3]["gates"] == "visa: must | hold; pay: low"
    empty = write_reports(decisions.limit(0), str(tmp_path / "none"), "x")
    assert "0 of 0 postings" in empty


def test_single_files(spark, tmp_path):
    (tmp_path / "resume.md").write_bytes("é\nb".encode())
    one = files.text_file(spark, str(tmp_path / "resume.md")).first()
    assert one.text == "é\nb" and one.sha256 == hashlib.sha256("é\nb".encode()).hexdigest() and one.modified
    docs = spark.createDataFrame([("profile.md", {"title": "Me", "tags": "a"}, "\n".join(map(str, range(20)))), ("notes/x.md", {}, "y")], "path string, meta map<string,string>, body string")
    assert files.profile_card(docs).first().card == "title: Me | type: profile.md | tags: a\n\n" + "\n".join(map(str, range(12)))
    assert files.profile_card(docs.where("path = 'notes/x.md'")).first().card == "No profile document published."


def test_answer_schema():
    assert answer_schema(False) == ANSWER and len(answer_schema(True).fields) == len(ANSWER.fields) + 4 and "gate_failures" not in ANSWER.fieldNames()
