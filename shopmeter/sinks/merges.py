"""Merging a new extract into the days already stored."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from shopmeter import journal
from shopmeter.schemas import conform
from shopmeter.sinks.writers import replace_days
from shopmeter.sources.tables import read_days


def merge_days(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing and new rows without full-row repeats; nulls compare equal."""
    return existing.unionByName(new, allowMissingColumns=True).dropDuplicates()


def write_merged_day(
    spark: SparkSession,
    new: DataFrame,
    path: str,
    schema: T.StructType,
    column: str,
    day: dt.date,
    table: str | None = None,
) -> None:
    """Merge the rows of one ``day`` into a dataset partitioned by ``column``.

    Only that day's folder is listed, read and replaced, after the merged day is safely
    written. Only a missing folder counts as empty: any other read error, a stored column
    that ``schema`` lacks or a stored value that it can't hold is raised, so a stored day
    never loses anything. ``table`` is the catalog's name of the dataset, if any.
    """
    journal.recover(spark, path)
    existing = read_days(spark, path, schema, column, [day], all_columns=True)
    replace_days(merge_days(existing, conform(new, schema)), path, column, [day], table=table)
