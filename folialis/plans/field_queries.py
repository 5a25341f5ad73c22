"""Queries on packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folialis.operators.multivalue import split_values
from folialis.plans.registry import query
from folialis.sources.tables import table


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every name and term of papers.authors and papers.keywords with its place."""
    return split_values(table(spark, d, "papers"), "id", ["authors", "keywords"]).withColumnRenamed("id", "paper_id")
