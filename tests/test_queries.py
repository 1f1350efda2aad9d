"""Every query with SQL must match it exactly on the smallest data; test_invariants has the others."""

import pytest

from plumbline.plans.catalogue import PLANS, SQL
from tests.parity import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    message, _, _ = compare(spark, con, name, PLANS[name], SQL.get(name), SF)
    assert message == "ok", message


def test_every_sql_has_a_query():
    assert set(SQL) <= set(PLANS)
