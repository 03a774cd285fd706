"""Filtered lookups. Nothing found is an empty result."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmeter.functions.dates import parse_day


def clients_by_city(clients: DataFrame, city: str) -> DataFrame:
    """Clients of a city, whatever the letter case."""
    return clients.filter(F.lower("city") == city.lower())


def all_products(products: DataFrame) -> DataFrame:
    return products


def all_stores(stores: DataFrame) -> DataFrame:
    return stores


def sales_by_date_store(sales: DataFrame, day: str | dt.date, store_id: str) -> DataFrame:
    return sales.filter(
        (F.col("sale_date") == F.lit(parse_day(day))) & (F.col("store_id") == store_id)
    )


def sales_by_hour(sales: DataFrame, day: str | dt.date, hour: int | str) -> DataFrame:
    """Sales of a day whose time starts with the given hour."""
    sold_at = F.substring("sale_time", 1, 2).try_cast("int")
    return sales.filter((F.col("sale_date") == F.lit(parse_day(day))) & (sold_at == int(hour)))


def traffic_by_date(
    traffic: DataFrame, day: str | dt.date, store_id: str | None = None
) -> DataFrame:
    """Hourly rows of a day, of one store if given; a malformed day is a ``ValueError``."""
    rows = traffic.filter(F.col("date") == F.lit(parse_day(day)))
    return rows if store_id is None else rows.filter(F.col("store_id") == store_id)


def metrics_for_store_name(
    metrics: DataFrame, stores: DataFrame, name: str | None = None
) -> DataFrame:
    """Metrics of the store with that name; of all stores when no name is given."""
    if name is None:
        return metrics
    chosen = stores.filter(F.col("name") == name).select(F.col("id").alias("store_id"))
    return metrics.join(chosen, "store_id", "left_semi")


def distinct_cities(clients: DataFrame) -> DataFrame:
    return clients.select("city").filter(F.col("city").isNotNull()).distinct()


def distinct_stores(stores: DataFrame) -> DataFrame:
    return stores.select("id").filter(F.col("id").isNotNull()).distinct()
