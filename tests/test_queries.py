"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from tests.check_oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, database, name):
    outcome = compare(spark, database, FOLDER, name)
    assert outcome.startswith(("ok", "rows-only")), outcome


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
