"""Every registered query against its SQL."""

import pytest

from heddlework.plans.catalog import ORACLES, QUERIES
from oracle import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf, name):
    same(spark, sf, QUERIES[name], ORACLES[name])


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
