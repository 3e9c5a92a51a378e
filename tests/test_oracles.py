"""Every query of the reference's operators against its oracle on the smallest tables."""

import pytest

from graphlode.plans import catalogue
from tests.oracle import DATA, differences

SF = str(DATA / "sf0.001")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, name):
    assert differences(catalogue.QUERIES[name](spark, SF), catalogue.ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_without_oracle(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_every_oracle_has_its_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
