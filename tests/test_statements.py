"""Every query against its independent SQL statement."""

import pytest
from compare import connect, differences
from conftest import SF_DIR

from shelfbook.oracle.statements import STATEMENTS
from shelfbook.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_statement():
    assert set(STATEMENTS) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(name, shop, con):
    assert differences(QUERIES[name](shop), con, STATEMENTS[name]) == []
