"""Read side: the KPI page and the detail page, as DataFrames."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmeter.functions.dates import in_period
from shopmeter.operators.kpi import (
    kpi_totals,
    kpi_variations,
    month_slice,
    with_valid_dates,
)
from shopmeter.operators.lookups import metrics_for_store_name
from shopmeter.operators.themes import DAILY, MONTHLY, theme_series


def kpi_page(
    metrics: DataFrame,
    stores: DataFrame,
    year: int,
    month: int,
    store_name: str | None = None,
    as_of: dt.date | None = None,
) -> tuple[DataFrame, DataFrame]:
    """KPI totals of a month and their change against the month before."""
    rows = metrics_for_store_name(with_valid_dates(metrics), stores, store_name)
    return (
        kpi_totals(month_slice(rows, year, month, as_of=as_of)),
        kpi_variations(rows, year, month, as_of=as_of),
    )


def detail_slice(
    metrics: DataFrame,
    stores: DataFrame,
    period: str,
    store_name: str | None = None,
    year: int | None = None,
    month: int | None = None,
) -> DataFrame:
    """The rows a detail view works on.

    The monthly view needs a year, the daily view a year and a month; the
    longer periods use all rows.
    """
    rows = metrics_for_store_name(metrics, stores, store_name)
    if period == MONTHLY:
        if year is None:
            raise ValueError("the monthly view needs a year")
        rows = rows.filter(in_period(F.col("date"), year))
    elif period == DAILY:
        if year is None or month is None:
            raise ValueError("the daily view needs a year and a month")
        rows = rows.filter(in_period(F.col("date"), year, month))
    return rows


def detail_page(
    metrics: DataFrame,
    stores: DataFrame,
    theme: str,
    period: str,
    store_name: str | None = None,
    year: int | None = None,
    month: int | None = None,
) -> DataFrame:
    """Series of a theme for the chosen stores and period: metric, x, y."""
    return theme_series(
        detail_slice(metrics, stores, period, store_name, year, month), theme, period
    )
