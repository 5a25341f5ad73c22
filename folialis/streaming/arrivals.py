"""Counts over arriving annotations. The library itself has no streams; this extends the facets to rows that keep coming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def arriving(spark: SparkSession, directory: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Rows of Parquet files as they are put into a directory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(directory)


def counted(annotations: DataFrame, window: str = "30 days", late: str = "120 days") -> DataFrame:
    """(start, kind, n): annotations by time of creation. Rows older than the watermark are dropped, ids that come twice count once."""
    once = annotations.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])
    return once.groupBy(F.window("at", window).alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
