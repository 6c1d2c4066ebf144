"""Every named query against its SQL, whole tables, smallest scale."""

import pytest

from checks.compare import connect, difference
from checks.oracle import ORACLES
from foliospark.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, small, name):
    assert difference(QUERIES[name](spark, small), con, ORACLES[name]) is None


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["book_id", "word_count", "tier", "n_languages", "translation_price", "addon_total", "total"]
    assert df.count() > 0
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())
