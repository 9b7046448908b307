import pytest

from oracle import same
from vecloom.plans.catalogue import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    same(QUERIES[name](spark, DIR), SQL[name], DIR)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - {"pockets", "angular_pockets"}))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
