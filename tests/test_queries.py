"""Every registered query of the engine against its SQL on the smallest tables."""

import pytest

from vigil import catalog

from .compare import same
from .conftest import SF


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    same(catalog.queries()[name](spark, SF), duck.sql(catalog.oracle_sql()[name]))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())
