"""Hourly store traffic: cleaning, outlier repair, daily totals and peak hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmeter.functions.numbers import PLACES, exact, zero_sum

MAX_VISITORS = 5000
DAY_KEY = ["date", "store_id"]
# Hours of a day; a row with another hour counts in totals but is no peak.
HOURS = 24
_HOUR_SLOTS = 32


def has_whole_counts(traffic: DataFrame) -> bool:
    return all(isinstance(traffic.schema[m].dataType, T.IntegralType) for m in ("visitors", "sales"))


def drop_unmeasured(traffic: DataFrame) -> DataFrame:
    """Drop rows with neither visitors nor sales; one of the two is enough to stay."""
    return traffic.filter(_measured(traffic, "visitors") | _measured(traffic, "sales"))


def _measured(traffic: DataFrame, measure: str) -> Column:
    value = F.col(measure)
    if isinstance(traffic.schema[measure].dataType, T.FractionalType):
        return value.isNotNull() & ~F.isnan(value)
    return value.isNotNull()


def _is_outlier(max_visitors: int) -> str:
    return f"coalesce(visitors > {int(max_visitors)}, false)"


def _repaired(sales: str, valid_sales: str, valid_visitors: str, mode: str) -> str:
    """Visitors implied by ``sales`` and the store's rate over its valid hours, as SQL.

    ``reference`` multiplies by the percentage rate, which restores plausible
    visitors only near a 10 % rate but is the published behaviour and the
    default. ``inverse_rate`` divides by the rate.
    """
    if mode == "reference":
        return f"CAST({sales} AS DOUBLE) * ({valid_sales} * 100 / {valid_visitors})"
    if mode == "inverse_rate":
        return f"try_divide(CAST({sales} AS DOUBLE) * {valid_visitors}, {valid_sales})"
    raise ValueError(f"unknown repair mode: {mode}")


def _valid_sums(max_visitors: int, whole: bool = True) -> list[Column]:
    """Sums over the valid hours; null for a store without any, which is left as it is."""
    valid = f"visitors > 0 AND visitors <= {int(max_visitors)}"
    # Fractional counts are summed as decimals, so that the order of rows doesn't matter.
    kind, shown = ("BIGINT", "BIGINT") if whole else (f"DECIMAL(27,{PLACES})", "DOUBLE")
    return [
        F.expr(f"CAST(sum(CASE WHEN {valid} THEN CAST({value} AS {kind}) END) AS {shown})").alias(name)
        for name, value in (("valid_sales", "coalesce(sales, 0)"), ("valid_visitors", "visitors"))
    ]


def _without_nan(traffic: DataFrame) -> DataFrame:
    """Fractional counts with gaps as nulls."""
    for measure in ("visitors", "sales"):
        if isinstance(traffic.schema[measure].dataType, T.FractionalType):
            traffic = traffic.withColumn(measure, F.nullif(F.col(measure), F.lit(float("nan"))))
    return traffic


def store_ratio(traffic: DataFrame, max_visitors: int = MAX_VISITORS) -> DataFrame:
    """Sales per 100 visitors of each store over the valid hours of the batch."""
    return (
        traffic.filter(F.col("store_id").isNotNull())
        .groupBy("store_id")
        .agg(*_valid_sums(max_visitors, has_whole_counts(traffic)))
        .withColumn("ratio", F.col("valid_sales") * 100 / F.col("valid_visitors"))
    )


def repair_outliers(
    traffic: DataFrame, max_visitors: int = MAX_VISITORS, mode: str = "reference"
) -> DataFrame:
    """Replace hours above ``max_visitors`` by the visitors their sales imply.

    The rate belongs to the store and the whole batch. Only the few outlier
    rows meet the per-store rates in a join; the bulk of the feed is neither
    shuffled nor grouped by store, so one store holding most rows costs nothing.
    """
    traffic = _without_nan(traffic.filter("store_id IS NOT NULL"))
    outlier = _is_outlier(max_visitors)
    as_double = F.expr("CAST(visitors AS DOUBLE)")
    implied = _repaired("sales", "valid_sales", "valid_visitors", mode)
    usual = traffic.filter(f"NOT {outlier}").withColumn("visitors", as_double)
    repaired = (
        traffic.filter(outlier)
        .join(store_ratio(traffic, max_visitors), "store_id", "left")
        .withColumn(
            "visitors", F.when(F.expr("valid_visitors IS NULL"), as_double).otherwise(F.expr(implied))
        )
        .select(*usual.columns)
    )
    return usual.unionByName(repaired)


def _pack(value: str) -> str:
    """Value and hour in one long: the maximum is the top value at its earliest hour.

    A maximum over longs stays a hash aggregate; over a struct it would sort
    the whole feed.
    """
    packed = f"CAST({value} AS BIGINT) * {_HOUR_SLOTS} + ({_HOUR_SLOTS - 1} - hour)"
    return f"CASE WHEN {_IS_HOUR} THEN {packed} END"


_IS_HOUR = f"hour BETWEEN 0 AND {HOURS - 1}"


def _packed_hour(packed: str) -> str:
    return f"CAST({_HOUR_SLOTS - 1} - pmod({packed}, {_HOUR_SLOTS}) AS INT)"


def _packed_value(packed: str) -> str:
    return f"shiftright({packed}, {_HOUR_SLOTS.bit_length() - 1})"


def _peak_hour(traffic: DataFrame, measure: str) -> Column:
    """Hour of the largest ``measure``: earliest on a tie, null when never measured."""
    if isinstance(traffic.schema[measure].dataType, T.IntegralType):
        return F.expr(_packed_hour(f"max({_pack(measure)})"))
    value, hour = F.col(measure), F.col("hour")
    measured = _measured(traffic, measure) & F.expr(_IS_HOUR)
    return F.max_by(F.when(measured, hour), F.when(measured, F.struct(value, -hour))).cast("int")


def _keyed(df: DataFrame) -> DataFrame:
    """Rows with a full (date, store) key; null keys form no group."""
    return df.filter(F.col("date").isNotNull() & F.col("store_id").isNotNull())


def daily_traffic(traffic: DataFrame) -> DataFrame:
    """Visitors, transactions and both peak hours per (date, store).

    Both peaks are always filled. The two maxima may fall in different hours.
    """
    return (
        _keyed(traffic)
        .groupBy(*DAY_KEY)
        .agg(
            F.coalesce(F.sum(exact(F.col("visitors"))), F.lit(0)).cast("double").alias("total_visitors"),
            zero_sum(F.when(_measured(traffic, "sales"), F.col("sales"))).alias(
                "total_transactions"
            ),
            _peak_hour(traffic, "sales").alias("peak_hour_sales"),
            _peak_hour(traffic, "visitors").alias("peak_hour_visitors"),
        )
    )


def traffic_day_parts(traffic: DataFrame, max_visitors: int = MAX_VISITORS) -> DataFrame:
    """Per (date, store): the sums and maxima from which repaired totals follow.

    Because the repair rate is one number per store, a day's repaired visitors
    follow from figures kept apart for usual and outlier hours. So the feed is
    read once and shuffled once, already reduced to a row per (date, store).
    Counts must be whole numbers; ``daily_traffic_repaired`` takes others.
    """
    if not has_whole_counts(traffic):
        raise TypeError("visitors and sales must be whole numbers")
    outlier = _is_outlier(max_visitors)
    usual_visitors = f"CASE WHEN NOT {outlier} THEN visitors END"
    outlier_visitors = f"CASE WHEN {outlier} THEN visitors END"
    sold = f"CASE WHEN {outlier} THEN sales END"
    parts = {
        "total_transactions": "coalesce(sum(CAST(sales AS BIGINT)), 0L)",
        "sales_peak": f"max({_pack('sales')})",
        "usual_visitors": f"coalesce(sum(CAST({usual_visitors} AS BIGINT)), 0L)",
        "usual_peak": f"max({_pack(usual_visitors)})",
        "raw_visitors": f"coalesce(sum(CAST({outlier_visitors} AS BIGINT)), 0L)",
        "raw_peak": f"max({_pack(outlier_visitors)})",
        "outlier_sales": f"coalesce(sum(CAST({sold} AS BIGINT)), 0L)",
        "outlier_peak": f"max({_pack(sold)})",
        "outlier_first_hour": f"min(CASE WHEN {outlier} AND sales IS NOT NULL AND {_IS_HOUR} THEN hour END)",
    }
    return (
        _keyed(drop_unmeasured(traffic))
        .groupBy(*DAY_KEY)
        .agg(
            *[F.expr(value).alias(name) for name, value in parts.items()],
            *_valid_sums(max_visitors),
        )
    )


PARTS = (
    "sales_peak usual_visitors usual_peak raw_visitors raw_peak outlier_sales outlier_peak "
    "outlier_first_hour valid_sales valid_visitors"
).split()


def finish_traffic_days(parts: DataFrame, mode: str = "reference") -> DataFrame:
    """Turn day parts into total visitors and peak hours, keeping all other columns.

    The store's rate is a window over its days, whose number the calendar
    bounds. A row without traffic parts gets null totals.
    """
    def implied(sales: str) -> str:
        return _repaired(sales, "store_sales", "store_visitors", mode)

    has_rate = "store_visitors IS NOT NULL"
    others = [name for name in parts.columns if name not in (*DAY_KEY, *PARTS)]
    rated = parts.selectExpr(
        "*",
        "sum(valid_sales) OVER (PARTITION BY store_id) AS store_sales",
        "sum(valid_visitors) OVER (PARTITION BY store_id) AS store_visitors",
    )
    peaks = rated.selectExpr(
        *DAY_KEY,
        *others,
        f"CASE WHEN {has_rate} THEN {implied(_packed_value('outlier_peak'))} "
        f"ELSE CAST({_packed_value('raw_peak')} AS DOUBLE) END AS outlier_value",
        # At a rate of 0 all repaired hours tie at 0 visitors, so the earliest wins.
        f"CASE WHEN store_visitors IS NULL THEN {_packed_hour('raw_peak')} "
        "WHEN store_sales = 0 THEN outlier_first_hour "
        f"ELSE {_packed_hour('outlier_peak')} END AS outlier_hour",
        f"CAST({_packed_value('usual_peak')} AS DOUBLE) AS usual_value",
        f"{_packed_hour('usual_peak')} AS usual_hour",
        f"usual_visitors + CASE WHEN {has_rate} THEN coalesce({implied('outlier_sales')}, 0D) "
        "ELSE CAST(raw_visitors AS DOUBLE) END AS total_visitors",
        f"{_packed_hour('sales_peak')} AS peak_hour_sales",
    )
    return peaks.selectExpr(
        *DAY_KEY,
        "total_visitors",
        "peak_hour_sales",
        """CAST(CASE WHEN outlier_value IS NULL THEN usual_hour
                WHEN usual_value IS NULL THEN outlier_hour
                WHEN usual_value > outlier_value THEN usual_hour
                WHEN usual_value < outlier_value THEN outlier_hour
                ELSE least(usual_hour, outlier_hour) END AS INT) AS peak_hour_visitors""",
        *others,
    )


def daily_traffic_repaired(
    traffic: DataFrame, max_visitors: int = MAX_VISITORS, mode: str = "reference"
) -> DataFrame:
    """Clean, repair and total the hourly feed in one pass over it.

    Same rows as ``daily_traffic(repair_outliers(drop_unmeasured(traffic)))``, which is
    what a feed of fractional counts goes through.
    """
    if not has_whole_counts(traffic):
        return daily_traffic(repair_outliers(drop_unmeasured(traffic), max_visitors, mode))
    return finish_traffic_days(traffic_day_parts(traffic, max_visitors), mode)
