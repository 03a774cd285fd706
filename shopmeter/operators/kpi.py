"""KPI totals of a month and their change against the month before."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmeter.functions.dates import in_period, previous_month
from shopmeter.functions.numbers import exact_sum, ratio
from shopmeter.schemas import parse_date

SUMMED = ["total_visitors", "total_transactions", "total_revenue", "total_cost", "total_margin"]
KPIS = [*SUMMED, "conversion_rate", "avg_transaction_value"]


def with_valid_dates(metrics: DataFrame) -> DataFrame:
    """Dates given as text become dates; rows without a readable date are dropped."""
    if dict(metrics.dtypes)["date"] == "string":
        metrics = metrics.withColumn("date", parse_date(F.col("date")))
    return metrics.dropna(subset=["date"])


def _month(year: int, month: int, last_day: int | None) -> Column:
    chosen = in_period(F.col("date"), year, month)
    if last_day is not None:
        chosen = chosen & (F.dayofmonth("date") <= last_day)
    return chosen


def _last_day(year: int, month: int, as_of: dt.date | None) -> int | None:
    """Day up to which the running month is compared; None for a closed month."""
    running = as_of is not None and (as_of.year, as_of.month) == (year, month)
    return as_of.day if running else None


def _of_store(metrics: DataFrame, store_id: str | None) -> DataFrame:
    return metrics if store_id is None else metrics.filter(F.col("store_id") == store_id)


def month_slice(
    metrics: DataFrame,
    year: int,
    month: int | None = None,
    store_id: str | None = None,
    as_of: dt.date | None = None,
) -> DataFrame:
    """Metrics of a year or month; the month of ``as_of`` stops at that day."""
    if month is None:
        chosen = in_period(F.col("date"), year)
    else:
        chosen = _month(year, month, _last_day(year, month, as_of))
    return _of_store(metrics, store_id).filter(chosen)


def previous_slice(
    metrics: DataFrame,
    year: int,
    month: int,
    store_id: str | None = None,
    as_of: dt.date | None = None,
) -> DataFrame:
    """Metrics of the month before, cut at the same day as the chosen month."""
    before = previous_month(year, month)
    return _of_store(metrics, store_id).filter(_month(*before, _last_day(year, month, as_of)))


def _or_zero(top: Column, bottom: Column, factor: int = 1) -> Column:
    return F.when(bottom > 0, ratio(top, bottom) * factor).otherwise(F.lit(0.0))


def kpi_totals(rows: DataFrame) -> DataFrame:
    """One row with the seven KPIs of ``rows`` and the amounts in millions."""
    totals = rows.agg(
        exact_sum(F.col("total_visitors")).alias("total_visitors"),
        exact_sum(F.col("total_transactions")).alias("total_transactions"),
        exact_sum(F.col("total_revenue")).alias("total_revenue"),
        exact_sum(F.col("total_cost")).alias("total_cost"),
    )
    visitors, sales = F.col("total_visitors"), F.col("total_transactions")
    totals = totals.withColumns(
        {
            "total_margin": F.col("total_revenue") - F.col("total_cost"),
            "conversion_rate": _or_zero(sales, visitors, 100),
            "avg_transaction_value": _or_zero(F.col("total_revenue"), sales),
        }
    )
    millions = {
        f"{name}_millions": F.col(f"total_{name}") / 1e6 for name in ("revenue", "cost", "margin")
    }
    return totals.withColumns(millions).select(*KPIS, *millions)


def kpi_variations(
    metrics: DataFrame,
    year: int,
    month: int,
    store_id: str | None = None,
    as_of: dt.date | None = None,
) -> DataFrame:
    """Percentage change of the seven KPIs against the month before, as one row.

    Null where the earlier value is 0, or not above 0 for cost and margin, and
    null throughout when either month has no row. Both months are read in one
    scan and summed side by side.
    """
    last_day = _last_day(year, month, as_of)
    current = _month(year, month, last_day)
    previous = _month(*previous_month(year, month), last_day)
    sums = []
    for label, chosen in (("now", current), ("then", previous)):
        sums.append(F.count_if(chosen).alias(f"rows_{label}"))
        for name in SUMMED:
            sums.append(exact_sum(F.when(chosen, F.col(name))).alias(f"{name}_{label}"))
    both = _of_store(metrics, store_id).filter(current | previous).agg(*sums)
    for label in ("now", "then"):
        visitors, sales = F.col(f"total_visitors_{label}"), F.col(f"total_transactions_{label}")
        both = both.withColumns(
            {
                f"conversion_rate_{label}": _or_zero(sales, visitors, 100),
                f"avg_transaction_value_{label}": _or_zero(F.col(f"total_revenue_{label}"), sales),
            }
        )
    comparable = (F.col("rows_now") > 0) & (F.col("rows_then") > 0)
    changes = []
    for name in KPIS:
        now, then = F.col(f"{name}_now"), F.col(f"{name}_then")
        usable = then > 0 if name in ("total_cost", "total_margin") else then != 0
        change = ratio(now - then, then) * 100
        changes.append(F.when(comparable & usable, change).alias(name))
    return both.select(*changes)
