"""Calendar series over the metrics table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmeter.functions.dates import month_start, quarter_label, quarter_rank
from shopmeter.functions.numbers import exact_mean, exact_sum, ratio

# Metrics that add up over stores and days; all others are averaged.
ADDITIVE = [
    "total_visitors",
    "total_transactions",
    "total_quantity",
    "total_revenue",
    "total_cost",
    "total_margin",
    "avg_revenue_last_4_weeks",
    "avg_visitors_last_4_weeks",
    "avg_sales_last_4_weeks",
]
# Ratios that a longer period computes anew from its totals.
REWEIGHTED = {
    "conversion_rate": lambda: ratio(
        100 * exact_sum(F.col("total_transactions")), exact_sum(F.col("total_visitors"))
    ),
    "avg_transaction_value": lambda: ratio(
        exact_sum(F.col("total_revenue")), exact_sum(F.col("total_transactions"))
    ),
}


def _daily_value(metric: str) -> Column:
    value = exact_sum if metric in ADDITIVE else exact_mean
    return value(F.col(metric)).alias(metric)


def _period_value(metric: str) -> Column:
    if metric in REWEIGHTED:
        return REWEIGHTED[metric]().alias(metric)
    return _daily_value(metric)


def with_calendar(metrics: DataFrame) -> DataFrame:
    """Add year and month numbers."""
    return metrics.withColumns({"year": F.year("date"), "month": F.month("date")})


def series_daily(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Per date: sums of additive metrics, plain means over stores of the rest."""
    return (
        metrics.filter(F.col("date").isNotNull())
        .groupBy("date")
        .agg(*[_daily_value(name) for name in names])
    )


def series_monthly(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Per month, labelled by its first day; the two ratios come from the month's totals."""
    return (
        with_calendar(metrics.filter(F.col("date").isNotNull()))
        .groupBy("year", "month")
        .agg(*[_period_value(name) for name in names])
        .select("year", "month", month_start(F.col("year"), F.col("month")).alias("month_start"), *names)
    )


def series_annual(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Per year; the two ratios come from the year's totals."""
    return (
        with_calendar(metrics.filter(F.col("date").isNotNull()))
        .groupBy("year")
        .agg(*[_period_value(name) for name in names])
    )


def averaged_columns(df: DataFrame) -> list[str]:
    """Numeric columns that are not additive, by name."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return sorted(set(numeric) - set(ADDITIVE))


def quarter_store_rollup(metrics: DataFrame) -> DataFrame:
    """Per quarter and store: additive metrics summed, every other number averaged."""
    dated = metrics.filter(F.col("date").isNotNull() & F.col("store_id").isNotNull())
    names = [*ADDITIVE, *averaged_columns(dated)]
    return dated.groupBy(
        quarter_label(F.col("date")).alias("quarter"),
        quarter_rank(F.col("date")).alias("quarter_for_sort"),
        "store_id",
    ).agg(*[_daily_value(name) for name in names])


def series_quarterly(rollup: DataFrame, names: list[str]) -> DataFrame:
    """Per quarter over the quarter-and-store rollup, so means are means of store means."""
    values = [_period_value(name) for name in names]
    return rollup.groupBy("quarter", "quarter_for_sort").agg(*values).orderBy("quarter_for_sort")


def available_periods(metrics: DataFrame) -> DataFrame:
    """Distinct (year, month) present, in order."""
    months = with_calendar(metrics.filter(F.col("date").isNotNull())).select("year", "month").distinct()
    return months.orderBy("year", "month")


def available_years(metrics: DataFrame, descending: bool = False) -> DataFrame:
    years = with_calendar(metrics.filter(F.col("date").isNotNull())).select("year").distinct()
    return years.orderBy(F.desc("year") if descending else F.asc("year"))
