"""Every registered query at the smallest scale against its SQL."""

import pytest

from compare import connect, difference, duck_rows, spark_rows
from timbre.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    rows = spark_rows(QUERIES[name](spark, SF))
    assert rows[1], "no rows"
    if name in ORACLES:
        assert difference(rows, duck_rows(duck, ORACLES[name])) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
