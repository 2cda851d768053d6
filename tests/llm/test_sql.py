"""Queries of the training-data operators that SQL can express."""

import pytest

from gridlark.llm import queries
from tests.conftest import DATA, rows_of


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(queries.ORACLE[name]).df()
    assert rows_of(got) == rows_of(want)
