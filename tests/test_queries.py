"""Every registered query that has SQL agrees with it; the others run."""

import subprocess
import sys
from pathlib import Path

import pytest
from oracle import compare, connect

import __spark_entry__ as entry_points
from larkspur.plans import case_queries, more_queries, source_queries, state_queries  # noqa: F401  register their queries
from larkspur.plans import queries as own

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_agrees_with_sql(spark, db, name):
    assert compare(spark, db, own.QUERIES[name], own.ORACLES[name], SMALL) == ""


@pytest.mark.parametrize("name", sorted(set(own.QUERIES) - set(own.ORACLES)))
def test_runs(spark, name):
    assert own.QUERIES[name](spark, SMALL).columns


def test_entry(spark):
    got = entry_points.entry(spark)
    assert got.columns[0] == "id" and got.count() > 0


def test_every_sql_has_its_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_modules_need_no_session_to_be_imported():
    """Names of queries are asked for before there is a session."""
    root = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "True", done.stderr
