"""Keyed upsert of store-days into the metrics table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from shopmeter import journal
from shopmeter.schemas import TRAFFIC_METRICS
from shopmeter.session import durable
from shopmeter.sinks.writers import write_metrics
from shopmeter.sources.tables import read_days

KEY = ["date", "store_id"]


def upsert(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows whose (date, store) is not in ``new``, plus all of ``new``."""
    kept = existing.join(new.select(*KEY), KEY, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def upsert_metrics(new: DataFrame, path: str, table: str | None = None) -> None:
    """Upsert ``new`` (unique per date and store) into the table at ``path``.

    The batch is computed once, then only the date partitions it touches are read, and
    replaced after the new ones are safely written; a store absent from the batch keeps its row. Running the
    same batch again leaves the table as it is. Only the batch's distinct dates
    come to the driver, at most one per calendar day. The days of ``table``, the catalog's name
    of it if any, are registered.
    """
    spark = new.sparkSession
    new = durable(new)
    days = sorted(row[0] for row in new.select("date").distinct().collect())
    if not days:
        return
    journal.recover(spark, path)
    touched = read_days(spark, path, TRAFFIC_METRICS, "date", days, all_columns=True)
    write_metrics(upsert(touched, new), path, days, table)
