"""Every query of the library against its SQL, or for rows where SQL can't express it."""

import pytest

from tests import oracle
from tidemark.plans import catalog


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_as_sql(spark, con, sf, name):
    assert oracle.compare(spark, con, catalog.QUERIES[name], catalog.ORACLE[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_gives_rows(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    assert df.columns and df.count() > 0
