"""Each registered query of the engine against its SQL."""

import pytest

from strata import queries
from tests.oracle import DATA, same


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    same(queries.QUERIES[name](spark, DATA), queries.SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
