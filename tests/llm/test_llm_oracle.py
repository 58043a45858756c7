import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
import oracle_check
from tavola.llm import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = oracle_check.duck("/root/testdata/sf0.001")
    df = queries.queries()[name](spark, "/root/testdata/sf0.001")
    rel = con.sql(oracle.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert oracle_check.digest(df.columns, [tuple(r) for r in df.collect()])[0] == oracle_check.digest(rel.columns, rel.fetchall())[0]
