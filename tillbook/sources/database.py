"""A store's tables from the source its configuration names."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Configuration keys.
DB_TYPE, HOST, PORT, DATABASE, USER, PASSWORD, FILE_NAME = "dbtype", "host", "port", "database", "uid", "pwd", "filename"


@dataclass(frozen=True)
class Partitioning:
    """How to cut a table into parallel reads."""

    column: str
    lower: int
    upper: int
    parts: int


def reader_options(config: Mapping[str, str]) -> dict[str, str]:
    """Format and options of the configured source, without the table."""
    kind = config.get(DB_TYPE, "").lower()
    if kind == "mysql":
        options = {
            "format": "jdbc",
            "url": f"jdbc:mysql://{config[HOST]}:{config.get(PORT, '3306')}/{config[DATABASE]}",
            "user": config[USER],
        }
        if config.get(PASSWORD):
            options["password"] = config[PASSWORD]
        return options
    if kind == "sqlite":
        return {"format": "jdbc", "url": f"jdbc:sqlite:{config[FILE_NAME]}"}
    if kind == "parquet":
        return {"format": "parquet", "path": config[FILE_NAME].rstrip("/")}
    raise ValueError(f"unknown {DB_TYPE} {kind!r}; use mysql, sqlite or parquet")


def read_store_table(
    spark: SparkSession,
    config: Mapping[str, str],
    table: str,
    partitioning: Partitioning | None = None,
    fetch_size: int = 10_000,
) -> DataFrame:
    """A lazy frame over one table. Database reads need the driver's jar.

    Filters and columns are pushed to the database. Give ``partitioning`` for
    anything large, otherwise the database serves one connection.
    """
    options = reader_options(config)
    kind = options.pop("format")
    if kind == "parquet":
        return spark.read.parquet(f"{options['path']}/{table}.parquet")
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table).option("fetchsize", fetch_size)
    if partitioning:
        reader = (
            reader.option("partitionColumn", partitioning.column)
            .option("lowerBound", partitioning.lower)
            .option("upperBound", partitioning.upper)
            .option("numPartitions", partitioning.parts)
        )
    return reader.load()
