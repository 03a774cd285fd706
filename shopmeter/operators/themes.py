"""Themes: which metrics a view of a period shows, and their tidy series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmeter.operators.rollups import (
    quarter_store_rollup,
    series_annual,
    series_daily,
    series_monthly,
    series_quarterly,
)

# Period names.
ANNUAL, QUARTERLY, MONTHLY, DAILY = "Annuel", "Trimestriel", "Mensuel", "Quotidien"

# Theme, metrics of every period, metrics of the daily view only.
THEMES = [
    ("Performance des visiteurs", ["total_visitors"],
     ["avg_visitors_last_4_weeks", "visitors_variation_vs_avg_4w_percent"]),
    ("Performance des transactions", ["total_transactions"],
     ["avg_sales_last_4_weeks", "transactions_variation_vs_avg_4w_percent"]),
    ("Quantité et revenus", ["total_revenue", "total_quantity"],
     ["avg_revenue_last_4_weeks", "revenue_variation_vs_avg_4w_percent"]),
    ("Marges et coûts", ["total_cost", "total_margin"], []),
    ("Efficacité des ventes", ["conversion_rate", "avg_transaction_value"], []),
    ("Indicateurs spécifiques par visiteur", ["revenue_per_visitor", "margin_per_visitor"], []),
]


def themes(period: str) -> dict[str, list[str]]:
    """All themes of a period with their metrics."""
    return {name: always + (daily_only if period == DAILY else []) for name, always, daily_only in THEMES}


def series(metrics: DataFrame, period: str, names: list[str]) -> DataFrame:
    """One row per period step: ``x`` as text and one double column per metric."""
    if period == DAILY:
        wide = series_daily(metrics, names).withColumn("x", F.col("date").cast("string"))
    elif period == MONTHLY:
        wide = series_monthly(metrics, names).withColumn("x", F.col("month_start").cast("string"))
    elif period == ANNUAL:
        wide = series_annual(metrics, names).withColumn("x", F.col("year").cast("string"))
    elif period == QUARTERLY:
        wide = series_quarterly(quarter_store_rollup(metrics), names).withColumn("x", F.col("quarter"))
    else:
        raise ValueError(f"unknown period: {period}")
    return wide.select("x", *[F.col(name).cast("double").alias(name) for name in names])


def theme_series(metrics: DataFrame, theme: str, period: str) -> DataFrame:
    """A theme's metrics in long form: metric, x, y. One aggregate serves them all."""
    names = themes(period).get(theme, [])
    if not names:
        raise ValueError(f"unknown theme: {theme}")
    return series(metrics, period, names).unpivot("x", names, "metric", "y").select(
        "metric", "x", "y"
    )
