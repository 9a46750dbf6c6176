"""Table sources: Parquet scans of input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_input(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table (``{sf_dir}/{name}.parquet``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

