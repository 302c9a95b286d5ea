"""Every query of the package on the smallest tables."""

import os

import pytest

from stackweave.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() >= 0


def test_sql_names():
    assert set(queries.SQL) <= set(queries.QUERIES)
