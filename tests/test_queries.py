"""Every query of the engine against its SQL, or, without SQL, that it gives rows."""

import os

import pytest

from tests.oracle import compare
from tidemark.plans import catalogue

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", catalogue.REGISTRY.queries)
def test_query(spark, name):
    query, sql = catalogue.REGISTRY.queries[name], catalogue.REGISTRY.sql.get(name)
    if sql is None:
        assert query(spark, SF).count() > 0
    else:
        compare(spark, query, sql, SF)
