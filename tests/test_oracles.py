import pytest

from tessera import catalog
from tests import oracle

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, duck, sf_dir, name):
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    assert set(got.columns) == set(want.columns)
    assert oracle.rows(got) == oracle.rows(want)
