"""Extraction jobs: JSON feeds into the stored datasets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmeter.functions.dates import parse_day
from shopmeter.schemas import CLIENTS, PRODUCTS, RETAIL_DATA, SALES, STORES
from shopmeter.session import durable
from shopmeter.sinks.merges import write_merged_day
from shopmeter.sinks.writers import require_rows, write_snapshot
from shopmeter.sources.tables import drop_error_rows, read_json_feed


def extract_sales(
    spark: SparkSession, feed: str, target: str, day: str | dt.date, lines: bool = True, table: str | None = None
) -> bool:
    """Merge one day's sale lines, of all stores at once, into the sales dataset.

    A feed without a line of that day writes nothing and returns False. A missing feed or
    one that is no JSON is an error, here as in all extractions, and leaves the target alone.
    ``table`` is the catalog's name of the target, if any; what is written shows there at once.
    """
    rows = drop_error_rows(read_json_feed(spark, feed, SALES, lines), ["sale_id", "store_id"])
    day = parse_day(day)
    rows = durable(rows.filter(F.col("sale_date") == F.lit(day)))
    if rows.isEmpty():
        return False
    write_merged_day(spark, rows, target, SALES, "sale_date", day, table)
    return True


def extract_traffic(
    spark: SparkSession, feed: str, target: str, day: str | dt.date, lines: bool = True, table: str | None = None
) -> None:
    """Merge one day's hourly rows into the traffic dataset; no row is an error."""
    rows = drop_error_rows(read_json_feed(spark, feed, RETAIL_DATA, lines), ["store_id"])
    day = parse_day(day)
    rows = require_rows(durable(rows.filter(F.col("date") == F.lit(day))), f"traffic on {day}")
    write_merged_day(spark, rows, target, RETAIL_DATA, "date", day, table)


def _replace(
    spark: SparkSession, feed: str, target: str, schema: T.StructType, lines: bool, allow_empty: bool, table: str | None
) -> None:
    """Replace a snapshot by a feed that was read to its end before."""
    rows = durable(drop_error_rows(read_json_feed(spark, feed, schema, lines), ["id"]))
    write_snapshot(rows if allow_empty else require_rows(rows, feed), target, table=table)


def extract_clients(
    spark: SparkSession, feed: str, target: str, lines: bool = True, allow_empty: bool = False, table: str | None = None
) -> None:
    """Replace the client snapshot; an empty feed is an error unless ``allow_empty``."""
    _replace(spark, feed, target, CLIENTS, lines, allow_empty, table)


def extract_stores(spark: SparkSession, feed: str, target: str, lines: bool = True, table: str | None = None) -> None:
    """Replace the store snapshot; an empty feed is an error."""
    _replace(spark, feed, target, STORES, lines, False, table)


def extract_products(spark: SparkSession, feed: str, target: str, lines: bool = True, table: str | None = None) -> None:
    """Replace the product snapshot; an empty feed is an error."""
    _replace(spark, feed, target, PRODUCTS, lines, False, table)
