"""Every query against its oracle on the smallest tables."""

import __spark_entry__ as driver
import pytest
from compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"
QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    table = QUERIES[name](spark, SF_DIR).toArrow()
    if name in ORACLES:
        assert differences(table, oracle.sql(ORACLES[name]).to_arrow_table()) == []
    else:
        assert table.num_rows > 0


def test_entry(spark):
    assert driver.entry(spark).columns == ["dimension", "name", "value"]
    assert set(ORACLES) <= set(QUERIES)
