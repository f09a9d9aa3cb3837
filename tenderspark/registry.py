"""All registered queries of the library and the SQL each is checked by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tenderspark.plans import evaluation, extract, ingest, lifecycle, pricing, retrieval, review, stored, text  # noqa: F401
from tenderspark.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market benchmark joined to price scenarios per tender."""
    return pricing.f15_pricing_dashboard(spark, sf_dir)
