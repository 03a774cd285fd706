"""External tables over the extracted datasets."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import SparkSession

from shopmeter.schemas import PARTITION_COLUMN, TABLES


def create_external_tables(
    spark: SparkSession, locations: dict[str, str], database: str | None = None
) -> list[str]:
    """Declare the five tables over their folders; existing declarations stay."""
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    names = []
    for table, location in locations.items():
        schema = TABLES[table]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        name = f"{database}.{table}" if database else table
        partition = PARTITION_COLUMN.get(table)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
            + (f"PARTITIONED BY (`{partition}`) " if partition else "")
            + f"LOCATION '{location}'"
        )
        names.append(name)
    return names


def register_days(spark: SparkSession, table: str, column: str, days: Iterable[dt.date]) -> None:
    """Register some days of a table, new or written anew; no folder of it is listed."""
    added = " ".join(f"PARTITION (`{column}` = DATE'{day.isoformat()}')" for day in days)
    if added:
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {added}")
        spark.catalog.refreshTable(table)


def refresh_partitions(spark: SparkSession, table: str) -> None:
    """Register partition folders that others added since the table was declared.

    This lists the whole table; the sinks of this library register what they write themselves.
    """
    spark.sql(f"MSCK REPAIR TABLE {table}")
