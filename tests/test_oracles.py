"""Every registered query with an SQL form gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import pytest

from tenderspark import registry
from tests.compare import database, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, db, name):
    assert spark_rows(registry.QUERIES[name](spark, SF)) == duck_rows(db, registry.ORACLES[name])


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, SF).limit(1).count() == 1
