"""Every query beside its SQL, on the smallest tables."""

import pytest

from tests.conftest import DATA, rows_of

from gridlark.plans import registry  # isort: skip


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name not in registry.ORACLE:
        assert len(got) > 0
        return
    want = duck.execute(registry.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_bounds_are_admissible(spark):
    out = registry.QUERIES["landmark_bound"](spark, DATA)
    assert out.filter("not admissible").isEmpty()


def test_entry(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns[:2] == ["station_id", "rank"]
