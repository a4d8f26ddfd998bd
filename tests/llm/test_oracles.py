"""Contract queries against their SQL in DuckDB, on whole small tables."""

import os
import sys

import pytest

pytest.importorskip("tributary.llm")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import differs  # noqa: E402

from tributary.llm import queries as q  # noqa: E402


@pytest.mark.parametrize("name", list(q.oracle_sql()))
def test_query_matches_sql(spark, name):
    assert differs(spark, q.queries()[name], q.oracle_sql()[name], "/root/testdata/sf0.001") == ""
