import os

import pytest

import __spark_entry__ as E
from compare import duck_rows, spark_rows

D = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_sql(spark, name):
    cols, want = duck_rows(E.oracle_sql()[name], D)
    got_cols, got = spark_rows(E.queries()[name](spark, D))
    assert got_cols == cols
    assert got == want
