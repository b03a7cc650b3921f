"""The registered queries of this package on the smallest tables, against SQL where there is."""

from __future__ import annotations

import os

import pytest

from tests.compare import connect, difference
from utterance_guard.llm.oracle import ORACLE
from utterance_guard.llm.queries import QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    if name in ORACLE:
        assert difference(frame, connect(FOLDER), ORACLE[name]) is None
    else:
        rows = "pages" if "page_id" in frame.columns else "documents"
        assert frame.count() == spark.read.parquet(f"{FOLDER}/{rows}.parquet").count()


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
