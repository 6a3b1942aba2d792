"""Adapters from supplied tables to the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table of a data folder; columns not named are not read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df
