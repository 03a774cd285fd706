"""The model tables expressed over the benchmark tables.

Stores are the nations, products the parts, clients the customers; an order is
a basket and its lines are sale lines. Hourly traffic counts the orders of a
(date, store, hour) and derives visitors from their value.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopmeter.functions.numbers import round_even
from shopmeter.plans.daily import daily_metrics
from shopmeter.sources.incremental import history_before

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
# Declared schemas of the tables the model is built from: no footer is read to plan a query.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
    "props string",
}
N_STORES = 25
# First date that the incremental queries treat as not processed yet.
CUTOVER = dt.date(1998, 7, 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("n_nationkey")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        key.cast("string").alias("id"),
        F.col("n_name").alias("name"),
        F.col("r_name").alias("location"),
        (100 + 140 * key).cast("int").alias("capacity"),
        F.when(key % 5 == 0, "0").otherwise((7 + key % 3).cast("string")).alias("opening_hour"),
        F.when(key % 5 == 0, "24").otherwise((19 + key % 4).cast("string")).alias("closing_hour"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth part is a product that the snapshot lacks."""
    part = table(spark, sf_dir, "part").filter(F.col("p_partkey") % 10 != 0)
    return part.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("price"),
        round_even(F.col("p_retailprice") * 0.65).alias("cost"),
    )


def flawed_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores without number 11, without the capacity of 12 and the hours of 13."""
    return stores(spark, sf_dir).filter("id <> '11'").selectExpr(
        "id", "name", "location", "if(id = '12', null, capacity) AS capacity",
        "if(id = '13', 'late', opening_hour) AS opening_hour", "closing_hour",
    )


def priced_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales whose lines of even baskets carry price times quantity, if the product is known."""
    lines, prices = sales(spark, sf_dir), products(spark, sf_dir).select(F.col("id").alias("product_id"), "price")
    amount = F.when(
        F.col("sale_id").cast("long") % 2 == 0, round_even(F.col("price") * F.col("quantity"))
    ).otherwise(F.col("sale_amount"))
    return lines.join(prices, "product_id", "left").withColumn("sale_amount", amount).select(*lines.columns)


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "r_name"
    )
    return customer.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("name"),
        F.floor(F.abs("c_acctbal") / 40).cast("int").alias("age"),
        F.lit(None).cast("string").alias("gender"),
        (F.col("c_mktsegment") == "BUILDING").alias("loyalty_card"),
        F.col("r_name").alias("city"),
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderpriority",
        "o_totalprice",
        F.col("o_orderdate").cast("date").alias("day"),
        (F.col("o_custkey") % N_STORES).cast("string").alias("store_id"),
        (F.col("o_orderkey") % 24).cast("int").alias("hour"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    orders = _orders(spark, sf_dir)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").cast("string").alias("sale_id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("nb_type_product"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("o_custkey").cast("string").alias("client_id"),
        "store_id",
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_extendedprice").alias("sale_amount"),
        F.concat(F.lpad(F.col("hour").cast("string"), 2, "0"), F.lit(":00:00")).alias("sale_time"),
        F.col("day").alias("sale_date"),
    )


def traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A visitor per 95 currency units; busy hours exceed the outlier limit.

    The counters of store 3 fail on every 13th of a month.
    """
    cents = F.sum(F.rint(F.col("o_totalprice") * 100).cast("long"))
    failed = (F.col("store_id") == "3") & (F.dayofmonth("day") == 13)
    hourly = (
        _orders(spark, sf_dir)
        .filter(~failed)
        .groupBy(F.col("day").alias("date"), "store_id", "hour")
        .agg(cents.alias("cents"), F.count("*").cast("int").alias("sales"))
    )
    return hourly.select(
        "store_id",
        F.concat(F.lit("NATION_"), F.col("store_id")).alias("store_name"),
        "hour",
        F.floor(F.col("cents") / 9500).cast("int").alias("visitors"),
        "sales",
        "date",
    )


def event_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly traffic from the event stream: events are visitors, purchases are sales."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.col("ts").cast("date").alias("date"),
            (F.col("user_id") % 5).cast("string").alias("store_id"),
            F.hour("ts").alias("hour"),
        )
        .agg(
            F.count("*").cast("int").alias("visitors"),
            F.count_if(F.col("event_type") == "purchase").cast("int").alias("sales"),
        )
    )


def gappy_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traffic whose visitors are missing at 3 and 5 h and sales at 3 and 7 h."""
    hour = F.col("hour")
    return traffic(spark, sf_dir).withColumns(
        {
            "visitors": F.when(~hour.isin(3, 5), F.col("visitors")),
            "sales": F.when(~hour.isin(3, 7), F.col("sales")),
        }
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics table of all dates processed as one batch."""
    return daily_metrics(
        traffic(spark, sf_dir), sales(spark, sf_dir), products(spark, sf_dir)
    )


def split_batch(spark: SparkSession, sf_dir: str):
    """Feeds from the cutover on, and the metrics published for the dates before."""
    day, first = F.col("date"), F.lit(CUTOVER)
    sale_day = F.col("sale_date")
    all_traffic, all_sales = traffic(spark, sf_dir), sales(spark, sf_dir)
    goods = products(spark, sf_dir)
    published = daily_metrics(
        all_traffic.filter(day < first), all_sales.filter(sale_day < first), goods
    )
    return all_traffic.filter(day >= first), all_sales.filter(sale_day >= first), goods, published


def incremental_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the dates from the cutover on, averaged over the published history."""
    new_traffic, new_sales, goods, published = split_batch(spark, sf_dir)
    return daily_metrics(new_traffic, new_sales, goods, history_before(published, CUTOVER))
