import pytest
from oracle import same

import __spark_entry__ as entry
from factloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLES[name], SF)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
