"""Every query with SQL gives the rows that SQL gives; the others run."""

from __future__ import annotations

import pytest

from postpulse.plans import catalogue
from tests.compare import canonical, connection

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connection(sf_dir)


def test_sql_has_a_query_each():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    found = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    answer = duck.execute(SQL[name])
    columns = [c[0] for c in answer.description]
    assert sorted(frame.columns) == sorted(columns)
    assert found == canonical(columns, answer.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).collect()
