"""Reading the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """Table ``name`` of ``data_dir``, one Parquet file or folder each."""
    return spark.read.parquet(f"{data_dir}/{name}.parquet")
