"""Readers of the model's tables; schemas are given, never inferred."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ingestlens.operators.filters import in_range
from ingestlens.schemas import EVENTS, TABLES


def load_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet", **options) -> DataFrame:
    """SRC1: one table below ``path``, with the model's schema; ``jdbc`` has its own and takes its own options."""
    if fmt == "jdbc":
        return spark.read.format(fmt).options(**options).load()
    return spark.read.schema(TABLES[name]).format(fmt).options(**options).load(f"{path}/{name}")


def load_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SRC1: all five."""
    return {name: load_table(spark, path, name) for name in TABLES}


def load_errors(spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """SRC2: errors in ``[start, end)``; only the months in question are listed and read."""
    return in_range(spark.read.schema(TABLES["error_logs"]).parquet(path), start, end)


def stream_events(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """SRC5: the event feed as a stream of Parquet files."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)
