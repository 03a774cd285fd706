"""The daily metrics job: from the two feeds to the published metrics table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmeter import journal
from shopmeter.operators.metrics import (
    DAY_KEY,
    as_metrics_table,
    fill_missing,
    final_metrics,
    moving_averages,
)
from shopmeter.operators.sales import sales_day
from shopmeter.operators.traffic import (
    MAX_VISITORS,
    daily_traffic_repaired,
    finish_traffic_days,
    has_whole_counts,
    traffic_day_parts,
)
from shopmeter.plans import recent
from shopmeter.schemas import PRODUCTS, RETAIL_DATA, SALES
from shopmeter.sinks.upsert import upsert_metrics
from shopmeter.sources.incremental import new_days
from shopmeter.sources.tables import day_folders, read_days, read_table


def daily_feeds(
    traffic: DataFrame,
    sales: DataFrame,
    products: DataFrame,
    max_visitors: int = MAX_VISITORS,
    mode: str = "reference",
) -> DataFrame:
    """Both feeds cleaned, totalled and merged: one row per (date, store).

    Same rows as merging ``daily_traffic_repaired`` with ``sales_day``. The feeds
    meet before the repair is finished: both sides of the join are still
    partitioned by its key, and the one shuffle by store that the repair rate
    needs also serves the averages.
    """
    if not has_whole_counts(traffic):
        days = daily_traffic_repaired(traffic, max_visitors, mode)
        return fill_missing(days.join(sales_day(sales, products), DAY_KEY, "full_outer"))
    parts = traffic_day_parts(traffic, max_visitors)
    merged = parts.join(sales_day(sales, products), DAY_KEY, "full_outer")
    return fill_missing(finish_traffic_days(merged, mode))


def daily_metrics(
    traffic: DataFrame,
    sales: DataFrame,
    products: DataFrame,
    history: DataFrame | None = None,
    max_visitors: int = MAX_VISITORS,
    mode: str = "reference",
) -> DataFrame:
    """The 24 published columns for every (date, store) of the batch."""
    days = daily_feeds(traffic, sales, products, max_visitors, mode)
    return as_metrics_table(final_metrics(moving_averages(days, history)))


def batch_start(traffic: DataFrame, sales: DataFrame) -> dt.date | None:
    """First date of the batch; on partitioned tables this reads no data columns."""
    first = [
        frame.agg(F.min(column)).first()[0]
        for frame, column in ((traffic, "date"), (sales, "sale_date"))
    ]
    return min((day for day in first if day is not None), default=None)


def run_daily_metrics(
    spark: SparkSession,
    traffic_path: str,
    sales_path: str,
    products_path: str,
    metrics_path: str,
    max_visitors: int = MAX_VISITORS,
    mode: str = "reference",
    full_history: bool = False,
    both_feeds: bool = False,
    table: str | None = None,
) -> bool:
    """Process the dates missing from the metrics table and upsert them into it.

    Returns False, with nothing written, when a feed or the product snapshot
    has no new rows. Errors are raised, never swallowed; a file that can't be read
    keeps its date unpublished. A row that arrives for a date already published is
    not picked up again. ``both_feeds`` leaves dates for later that one feed lacks.
    ``full_history`` averages over all published rows instead of the four weeks
    before the batch. Both come from the rows kept beside the metrics table where the batch
    follows the published dates (:mod:`shopmeter.plans.recent`). Writes that were cut off, of any of the tables, are finished first.
    ``table`` is the catalog's name of the metrics table, if any; the days written show there.
    """
    for path in (traffic_path, sales_path, products_path, metrics_path):
        journal.recover(spark, path)
    done = day_folders(spark, metrics_path, "date")
    days = new_days(spark, traffic_path, "date", done)
    sale_days = new_days(spark, sales_path, "sale_date", done)
    if both_feeds:
        days = sale_days = sorted(set(days) & set(sale_days))
    traffic = read_days(spark, traffic_path, RETAIL_DATA, "date", days)
    sales = read_days(spark, sales_path, SALES, "sale_date", sale_days)
    products = read_table(spark, products_path, PRODUCTS)
    if traffic.isEmpty() or sales.isEmpty() or products.isEmpty():
        return False
    start = min([*days, *sale_days])
    last = recent.following(spark, metrics_path, done, start, full_history)
    history = recent.history(spark, metrics_path, done, start, last, full_history)
    batch = daily_metrics(traffic, sales, products, history, max_visitors, mode)
    upsert_metrics(batch, metrics_path, table)
    recent.keep(spark, metrics_path, done, last, full_history)
    return True


def pending_days(spark: SparkSession, traffic_path: str, sales_path: str, metrics_path: str) -> list[dt.date]:
    """Unpublished dates that only one of the feeds has."""
    done = day_folders(spark, metrics_path, "date")
    return sorted(
        set(new_days(spark, traffic_path, "date", done)) ^ set(new_days(spark, sales_path, "sale_date", done))
    )
