"""Registered queries against their SQL on the smallest tables.

``SENTRYLANE_QUERIES`` names the beginnings of those to compare; all by default.
"""

import os

import pytest

import compare
import __spark_entry__ as entry

FOLDER = os.environ.get("SENTRYLANE_DATA", "/root/testdata/sf0.001")
WANTED = tuple(os.environ.get("SENTRYLANE_QUERIES", "").split(","))
NAMES = [n for n in entry.oracle_sql() if n.startswith(WANTED)]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no data tables here")


@pytest.fixture(scope="module")
def database():
    return compare.database(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, database, name):
    problem = compare.compare(spark, database, name, entry.queries()[name], entry.oracle_sql()[name], FOLDER)
    assert problem is None, problem


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["repo", "total_findings", "should_fail"]
