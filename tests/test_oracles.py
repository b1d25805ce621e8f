"""Every named query with an SQL counterpart, side by side on the sf0.01 tables."""

import pytest
from oracle_compare import DATA, compare, duck

from loanvane.checks.oracles import ORACLES
from loanvane.checks.queries import QUERIES

SF = "0.01"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_counterpart_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    found = QUERIES[name](spark, str(DATA / f"sf{SF}")).toPandas()
    assert len(found) > 0
    assert compare(found, con.execute(ORACLES[name]).df()) == ""
