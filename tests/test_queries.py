"""Every query of the library against its SQL, and the contract's module."""

import pytest

from lodefinder.plans.queries import ORACLE, QUERIES
from tests.compare import connect, duck_rows, spark_rows


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, sf_dir, duck, name):
    columns, rows = spark_rows(QUERIES[name](spark, sf_dir))
    assert (columns, rows) == duck_rows(duck, ORACLE[name])


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns[:2] == ["entity_id", "item_pos"]
