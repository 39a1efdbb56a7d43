"""Every query that has SQL gives the rows of its SQL."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry_points
from conftest import ROOT, SF
from oracle import connect, differences

ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert differences(entry_points.queries()[name](spark, SF), con, ORACLES[name]) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry_points.queries())


def test_entry_runs(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["t_id", "probability"]
    assert df.count() == 146


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
