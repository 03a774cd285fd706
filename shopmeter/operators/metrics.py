"""Merged store-days: weekday, four-row averages and the derived KPIs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopmeter.functions.dates import weekday_name
from shopmeter.functions.numbers import exact, ratio, round_even
from shopmeter.schemas import TRAFFIC_METRICS

DAY_KEY = ["date", "store_id"]
AVERAGES = {
    "total_transactions": "avg_sales_last_4_weeks",
    "total_visitors": "avg_visitors_last_4_weeks",
    "total_revenue": "avg_revenue_last_4_weeks",
}


RATIOS = {
    "conversion_rate": "CASE WHEN total_visitors > 0 "
    "THEN try_divide(total_transactions * 100, total_visitors) END",
    "avg_transaction_value": "CASE WHEN total_transactions > 0 "
    "THEN try_divide(total_revenue, total_transactions) END",
    "revenue_per_visitor": "CASE WHEN total_visitors > 0 "
    "THEN try_divide(total_revenue, total_visitors) END",
    "total_margin": "total_revenue - total_cost",
    "margin_per_visitor": "CASE WHEN total_visitors > 0 "
    "THEN try_divide(total_revenue - total_cost, total_visitors) END",
}


def _variation(value: str, base: str) -> str:
    return f"try_divide(({value} - {base}) * 100, {base})"


VARIATIONS = {
    "visitors_variation_vs_avg_4w_percent": _variation(
        "total_visitors", "avg_visitors_last_4_weeks"
    ),
    "transactions_variation_vs_avg_4w_percent": _variation(
        "total_transactions", "avg_sales_last_4_weeks"
    ),
    "revenue_variation_vs_avg_4w_percent": _variation("total_revenue", "avg_revenue_last_4_weeks"),
    "transactions_amount_variation_vs_avg_4w_percent": _variation(
        "avg_transaction_value", "try_divide(avg_revenue_last_4_weeks, avg_sales_last_4_weeks)"
    ),
}


def fill_missing(merged: DataFrame) -> DataFrame:
    """Numbers missing after the merge become 0; text stays null."""
    return merged.na.fill(0)


def with_weekday(df: DataFrame) -> DataFrame:
    return df.withColumn("day_of_week", weekday_name(F.col("date")))


def moving_averages(
    batch: DataFrame, history: DataFrame | None = None, rows: int = 4
) -> DataFrame:
    """Add the mean of the current and up to three earlier same-weekday rows.

    The frame counts rows, not weeks: a gap in the dates stretches it. History
    rows only feed the frame and are not returned. A (store, weekday) group has
    at most one row per week, so no group grows with the size of the feeds.
    """
    batch = with_weekday(batch.filter(F.col("date").isNotNull() & F.col("store_id").isNotNull()))
    rows_in = batch.withColumn("is_new", F.lit(True))
    if history is not None:
        past = with_weekday(history.select(*DAY_KEY, *AVERAGES)).withColumn("is_new", F.lit(False))
        rows_in = rows_in.unionByName(past, allowMissingColumns=True)
    frame = (
        Window.partitionBy("store_id", "day_of_week")
        .orderBy("date", "is_new")
        .rowsBetween(1 - rows, 0)
    )

    def mean(measure: str):
        if measure == "total_revenue":
            # Summed exactly: a quarter of a sum of cents often ends on a rounding tie.
            total = F.sum(exact(F.col(measure))).over(frame).cast("double")
        else:
            total = F.sum(F.col(measure).cast("double")).over(frame)
        return round_even(ratio(total, F.count(measure).over(frame)))

    averaged = rows_in.withColumns({name: mean(measure) for measure, name in AVERAGES.items()})
    return averaged.filter("is_new").select(*batch.columns, *AVERAGES.values())


def last_rows(metrics: DataFrame, rows: int = 3) -> DataFrame:
    """The latest rows of each store and weekday: all that :func:`moving_averages` looks back to.

    Date, store and the averaged measures. Rows without a date or store are none. A group has a
    row per week of ``metrics``, and Spark cuts it to ``rows`` before and after the shuffle.
    """
    keyed = with_weekday(metrics.select(*DAY_KEY, *AVERAGES).dropna(subset=DAY_KEY))
    latest = Window.partitionBy("store_id", "day_of_week").orderBy(F.desc("date"))
    return keyed.withColumn("place", F.row_number().over(latest)).filter(F.col("place") <= rows).drop("place", "day_of_week")


def final_metrics(df: DataFrame) -> DataFrame:
    """Add the ratios, margins and variations against the averages.

    Missing average columns count as null. Where a plain division would give
    infinity or NaN the result is null.
    """
    missing = [name for name in AVERAGES.values() if name not in df.columns]
    df = df.withColumns({name: F.lit(None).cast("double") for name in missing})
    df = df.withColumns({name: F.expr(text) for name, text in RATIOS.items()})
    return df.withColumns({name: F.expr(text) for name, text in VARIATIONS.items()})


def as_metrics_table(df: DataFrame) -> DataFrame:
    """The published columns, in order and typed."""
    return df.selectExpr(
        *[f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in TRAFFIC_METRICS]
    )
