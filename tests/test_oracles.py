"""Every registered query against its SQL (or for rows), on whole tables."""

import check
import pytest

from __spark_entry__ import entry, oracle_sql, queries

ORACLES = oracle_sql()

# Selective queries that rightly find nothing at the smallest size.
MAY_BE_EMPTY = {"j11_position_assignment", "j11_assign_then_gate", "j11_gate_first_totals"}


@pytest.fixture(scope="module")
def con(folder):
    return check.connect(folder)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, folder, name):
    problem = check.compare(spark, con, folder, queries()[name], ORACLES.get(name))
    assert problem == "" or (problem == "no rows" and name in MAY_BE_EMPTY), problem


def test_entry(spark):
    assert entry(spark).count() == 2


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(queries())
