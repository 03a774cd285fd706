"""Incremental reads: which dates are done, which files are new, recent history."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmeter import journal
from shopmeter.schemas import parse_date
from shopmeter.sources.tables import day_folders, read_days, read_mixed


def processed_dates(metrics: DataFrame) -> DataFrame:
    """Distinct dates of the metrics table."""
    return metrics.select("date").filter(F.col("date").isNotNull()).distinct()


def processed_days(metrics: DataFrame) -> list[dt.date]:
    """Processed dates as a list on the driver, at most one per calendar day."""
    return sorted(row[0] for row in processed_dates(metrics).collect())


def not_processed(feed: DataFrame, column: str, processed: DataFrame) -> DataFrame:
    """Rows of dates that are not processed yet; rows without a date are none of them."""
    done = processed.select(F.col("date").alias(column)).distinct()
    return feed.join(done, column, "left_anti")


def new_days(spark: SparkSession, path: str, column: str, processed: Sequence[dt.date]) -> list[dt.date]:
    """Dates of a dataset's folders that are not processed yet."""
    done = set(processed)
    return [day for day in day_folders(spark, path, column) if day not in done]


def read_unprocessed(
    spark: SparkSession, path: str, schema: T.StructType, column: str, processed: Sequence[dt.date]
) -> DataFrame:
    """New dates of a dataset partitioned by ``column``; a missing dataset has none.

    The names of the day folders tell the new dates; only their folders are listed and
    read. A file that can't be read is an error: its date would count as processed.
    """
    return read_days(spark, path, schema, column, new_days(spark, path, column, processed))


_FILE_DAY = r"_(\d{4}-\d{2}-\d{2})\.parquet$"


def read_unprocessed_files(
    spark: SparkSession, folder: str, schema: T.StructType, processed: Sequence[dt.date]
) -> DataFrame:
    """New files of a flat folder named ``<anything>_YYYY-MM-DD.parquet``.

    The date comes from the file name; other files are ignored. However many files a day
    has, the driver keeps its date only and reads them by a pattern.
    """
    found = (re.search(_FILE_DAY, name) for name in journal.names(spark, folder))
    days = {match[1] for match in found if match} - {day.isoformat() for day in processed}
    patterns = [f"{folder.rstrip('/')}/*_{day}.parquet" for day in sorted(days)]
    return read_mixed(spark, patterns, schema)


def date_of_file(name: Column) -> Column:
    """Date in a file name column, null when it carries none."""
    text = F.regexp_extract(name, _FILE_DAY, 1)
    return parse_date(F.nullif(text, F.lit("")))


def history_before(metrics: DataFrame, start: dt.date, weeks: int = 4) -> DataFrame:
    """Metrics of the weeks before ``start``: from that many weeks back, up to the day before."""
    first = start - dt.timedelta(weeks=weeks)
    return metrics.filter((F.col("date") >= F.lit(first)) & (F.col("date") < F.lit(start)))
