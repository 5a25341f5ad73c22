"""Reading the library's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The tables a library directory may hold, one Parquet file or directory each.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "papers", "paper_tags", "annotations", "categories", "tags", "models", "author_register", "venue_register",
)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a library directory, lazily; Catalyst prunes its columns."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def register_views(spark: SparkSession, directory: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views of the tables, for use from spark.sql."""
    for n in names:
        table(spark, directory, n).createOrReplaceTempView(n)
