"""Every named query runs on the small tables and, where it has SQL, equals DuckDB."""

import oracle
import pytest

from epochlens import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    ok, msg = oracle.check(spark, name, SF, con)
    assert ok, msg


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
