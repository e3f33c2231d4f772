"""All queries of the engine proper."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import domain, flows, reading, relational, scalar
from tidemark.plans.registry import Registry

REGISTRY = Registry()
for part in (relational, scalar, domain, flows, reading):
    for name, query in part.REGISTRY.queries.items():
        REGISTRY.add(name, part.REGISTRY.sql.get(name))(query)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return REGISTRY.queries["c11_hot_candidates"](spark, sf_dir)
