"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as contract
from utterance_guard.plans.queries import registered
from tests.compare import connect, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registered()))
def test_query(spark, name):
    frame = contract.queries()[name](spark, FOLDER)
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert frame.count() > 0
    else:
        assert difference(frame, connect(FOLDER), sql) is None


def test_entry(spark):
    assert contract.entry(spark).count() == 200


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
