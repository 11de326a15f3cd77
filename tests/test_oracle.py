"""Every query against its SQL, and the driver's entry points."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_points
from checks.catalog import QUERIES
from checks.compare import differences, oracle_connection
from checks.oracle import ORACLE

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def oracle():
    return oracle_connection(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    assert differences(spark, oracle, SF, name) == ""
