"""Every registered query of the library gives the rows of its SQL."""

import pytest

from conftest import DATA, assert_same
from quillspark.plans.catalogue import ORACLES, QUERIES


#: SQL cannot align or match what these align and match; test_editorial.py compares them with plain Python.
WITHOUT_SQL = {"revision_hunks", "proof_report"}


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys() | WITHOUT_SQL and not ORACLES.keys() & WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    assert_same(QUERIES[name](spark, DATA), duck, ORACLES[name])
