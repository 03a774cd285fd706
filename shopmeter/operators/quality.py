"""Reconciliation of the two feeds and data-quality checks.

Checks return the offending rows or groups; an empty result is a pass. Where a
check depends on few columns the feed is reduced to those first, so dimension
joins run on the reduced rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmeter.functions.dates import is_weekend
from shopmeter.functions.numbers import round_even, zero_sum
from shopmeter.operators.skew import split_join
from shopmeter.operators.traffic import MAX_VISITORS


def baskets_per_store(sales: DataFrame) -> DataFrame:
    """Distinct baskets per store, most first. Spark counts them in two steps, (store, basket) first."""
    return (
        sales.filter(F.col("store_id").isNotNull())
        .groupBy("store_id")
        .agg(F.count_distinct("sale_id").alias("total_sales"))
        .orderBy(F.desc("total_sales"), "store_id")
    )


def _opening(stores: DataFrame) -> DataFrame:
    return stores.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("store_id"),
        F.col("opening_hour").try_cast("int").alias("opening_hour"),
        F.col("closing_hour").try_cast("int").alias("closing_hour"),
    )


def _is_open() -> Column:
    hour = F.col("hour").try_cast("int")
    return (hour >= F.col("opening_hour")) & (hour < F.col("closing_hour"))


def open_hours_sales(traffic: DataFrame, stores: DataFrame) -> DataFrame:
    """Traffic sales inside opening hours per store, most first; stores without any are left out."""
    hourly = (
        traffic.filter(F.col("store_id").isNotNull())
        .groupBy("store_id", "hour")
        .agg(F.sum(F.col("sales").cast("long")).alias("sales"))
    )
    return (
        hourly.join(_opening(stores), "store_id", "left")
        .filter(_is_open())
        .groupBy("store_id")
        .agg(F.sum("sales").alias("total_sales"))
        .filter(F.col("total_sales").isNotNull())
        .orderBy(F.desc("total_sales"), "store_id")
    )


def reconcile_sales_traffic(
    sales: DataFrame, traffic: DataFrame, stores: DataFrame, only_mismatches: bool = False
) -> DataFrame:
    """Baskets against traffic sales per store, a missing side as null."""
    baskets = baskets_per_store(sales).withColumnRenamed("total_sales", "basket_sales")
    counted = open_hours_sales(traffic, stores).withColumnRenamed("total_sales", "traffic_sales")
    both = baskets.join(counted, "store_id", "full_outer").withColumn(
        "matches", F.col("basket_sales").eqNullSafe(F.col("traffic_sales"))
    )
    return both.filter(~F.col("matches")) if only_mismatches else both


def closed_hours(traffic: DataFrame, stores: DataFrame) -> DataFrame:
    """Hours with visitors or sales while the store is closed, or where that can't be told.

    ``reason`` is ``closed``, ``unknown store`` or ``unreadable hours``, the last also for
    a row without an hour.
    """
    active = F.coalesce(F.col("visitors") > 0, F.lit(False)) | F.coalesce(F.col("sales") > 0, F.lit(False))
    hour = F.col("hour").try_cast("int")
    unreadable = hour.isNull() | F.col("opening_hour").isNull() | F.col("closing_hour").isNull()
    reason = (
        F.when(F.col("known").isNull(), "unknown store")
        .when(unreadable, "unreadable hours")
        .when(~_is_open(), "closed")
    )
    return (
        traffic.filter(active)
        .join(_opening(stores).withColumn("known", F.lit(True)), "store_id", "left")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select("date", "store_id", "hour", "visitors", "sales", "opening_hour", "closing_hour", "reason")
    )


def over_capacity(
    traffic: DataFrame, stores: DataFrame, weekend_factor: float = 1.25
) -> DataFrame:
    """Hours with more visitors than the store holds; weekends may exceed it by the factor.

    ``reason`` is ``over capacity``, or why visitors can't be checked: ``unknown store``,
    ``missing capacity`` or ``missing date``.
    """
    capacity = stores.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("store_id"), "capacity", F.lit(True).alias("known")
    )
    limit = F.when(is_weekend(F.col("date")), F.floor(F.col("capacity") * weekend_factor)).otherwise(
        F.col("capacity")
    )
    reason = (
        F.when(F.col("known").isNull(), "unknown store")
        .when(F.col("capacity").isNull(), "missing capacity")
        .when(F.col("date").isNull(), "missing date")
        .when(F.col("visitors") > F.col("visitor_limit"), "over capacity")
    )
    return (
        traffic.filter(F.col("visitors") > 0)
        .join(capacity, "store_id", "left")
        .withColumn("visitor_limit", limit.cast("int"))
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select("date", "store_id", "hour", "visitors", "visitor_limit", "reason")
    )


def traffic_profile(traffic: DataFrame, max_visitors: int = MAX_VISITORS) -> DataFrame:
    """Hours, unmeasured hours and outlier hours per store, with their rates."""
    unmeasured = F.col("visitors").isNull() & F.col("sales").isNull()
    return (
        traffic.filter(F.col("store_id").isNotNull())
        .groupBy("store_id")
        .agg(
            F.count("*").alias("hours"),
            F.count_if(unmeasured).alias("null_hours"),
            F.count_if(F.col("visitors") > max_visitors).alias("outlier_hours"),
        )
        .withColumns(
            {
                "null_rate": F.col("null_hours") / F.col("hours"),
                "outlier_rate": F.col("outlier_hours") / F.col("hours"),
            }
        )
    )


def line_amount_errors(
    sales: DataFrame, products: DataFrame, tolerance: float = 0.005
) -> DataFrame:
    """Lines whose amount is not price times quantity to two decimals, or can't be checked.

    ``reason`` is ``other amount``, ``unknown product`` or ``missing value``.
    """
    prices = products.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("product_id"), "price", F.lit(True).alias("known")
    )
    expected = round_even(F.col("price") * F.col("quantity"))
    agrees = F.abs(F.col("sale_amount") - F.col("expected_amount")) <= tolerance
    reason = (
        F.when(F.col("known").isNull(), "unknown product")
        .when(agrees.isNull(), "missing value")
        .when(~agrees, "other amount")
    )
    return (
        split_join(sales, prices, "product_id", "left")
        .withColumn("expected_amount", expected)
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select("sale_id", "product_id", "quantity", "sale_amount", "expected_amount", "reason")
    )


def basket_size_errors(sales: DataFrame) -> DataFrame:
    """Baskets with a line that declares another number of distinct products than found."""
    found = F.col("found")
    return (
        sales.filter(F.col("sale_id").isNotNull())
        .groupBy("sale_id")
        .agg(
            F.min("nb_type_product").alias("declared_least"),
            F.max("nb_type_product").alias("declared"),
            F.count_distinct("product_id").alias("found"),
        )
        .filter(
            ~(F.col("declared_least").eqNullSafe(found) & F.col("declared").eqNullSafe(found))
        )
        .select("sale_id", "declared", "found")
    )


def client_city_errors(
    sales: DataFrame, clients: DataFrame, stores: DataFrame
) -> DataFrame:
    """(client, store) pairs with sales where the client lives elsewhere, with their lines.

    ``reason`` is ``other city``, ``unknown client`` or ``unknown store``; the client's
    comes first if both are unknown. Neither place known is another city too.
    """
    pairs = sales.groupBy("client_id", "store_id").agg(F.count("*").alias("lines"))
    homes = clients.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("client_id"), "city", F.lit(True).alias("known_client")
    )
    places = stores.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("store_id"), "location", F.lit(True).alias("known_store")
    )
    same = F.coalesce(F.col("city") == F.col("location"), F.lit(False))
    reason = (
        F.when(F.col("known_client").isNull(), "unknown client")
        .when(F.col("known_store").isNull(), "unknown store")
        .when(~same, "other city")
    )
    return (
        pairs.join(homes, "client_id", "left")
        .join(places, "store_id", "left")
        .withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .select("client_id", "store_id", "city", "location", "lines", "reason")
    )


def unrealistic_ages(clients: DataFrame, limit: int = 200) -> DataFrame:
    return clients.filter(F.col("age") >= limit)


def feed_quality(feed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, rows carrying an error message and rows lacking a key, of a raw feed."""
    no_key = F.lit(False)
    for key in keys:
        no_key = no_key | F.col(key).isNull()
    return feed.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("error").isNotNull()).alias("error_rows"),
        F.count_if(no_key).alias("keyless_rows"),
        zero_sum(F.when(F.col("error").isNull() & ~no_key, 1).otherwise(0)).alias("usable_rows"),
    )
