"""All queries of the engine, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinset.plans import function_queries, pairing_queries, pipelines, protocol_queries, similarity_queries, statistics_queries
from kinset.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship", "function_queries", "pairing_queries", "pipelines", "protocol_queries", "similarity_queries", "statistics_queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.document_accuracy(spark, sf_dir)
