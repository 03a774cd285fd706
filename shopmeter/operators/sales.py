"""Sale lines: cost join, daily totals and best sellers.

Every aggregate first reduces lines to (date, store, product). Partial sums do
that before the shuffle, so a product or store that holds a third of all lines
reaches the shuffle as a handful of rows per task, and products are joined to
the reduced rows rather than to the lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmeter.functions.numbers import (
    PLACES,
    beside_cents,
    cents,
    exact,
    from_cents,
    money_sum,
    round_even,
    zero_sum,
)
from shopmeter.operators.skew import split_join

DAY_KEY = ["date", "store_id"]


def sales_with_cost(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Lines of known products with name, unit cost and line cost.

    Every line is joined; products that many lines share don't meet in one task.
    """
    known = products.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("product_id"), "cost", "name"
    )
    return split_join(sales, known, "product_id").withColumn(
        "total_cost", F.col("quantity") * F.col("cost")
    )


def _by_product(sales: DataFrame) -> DataFrame:
    return (
        sales.filter(F.col("sale_date").isNotNull() & F.col("store_id").isNotNull())
        .groupBy(F.col("sale_date").alias("date"), "store_id", "product_id")
        .agg(
            zero_sum(F.col("quantity")).alias("quantity"),
            F.sum(cents(F.col("sale_amount"))).alias("cents"),
            F.sum(beside_cents(F.col("sale_amount"))).alias("rest"),
        )
    )


def _named_products(products: DataFrame) -> DataFrame:
    """One row per (id, name) with its cost; ``copies`` is 1 for a clean snapshot."""
    return (
        products.filter(F.col("id").isNotNull())
        .select(F.col("id").alias("product_id"), "name", exact(F.col("cost")).alias("cost"))
        .groupBy("product_id", "name")
        .agg(F.count("*").alias("copies"), F.sum("cost").alias("cost"))
    )


def _catalogue(products: DataFrame) -> DataFrame:
    """Exactly one row per product id, whatever the snapshot repeats.

    A repeated id then raises cost and product quantity as the inner join
    would, and never the revenue.
    """
    label = F.struct("copies", "name")
    return (
        _named_products(products)
        .groupBy("product_id")
        .agg(
            F.sum("cost").alias("unit_cost"),
            F.max(F.when(F.col("name").isNotNull(), label)).alias("label"),
        )
    )


def daily_sales(sales: DataFrame) -> DataFrame:
    """Quantity and revenue per (date, store); unknown products count too."""
    return (
        sales.filter(F.col("sale_date").isNotNull() & F.col("store_id").isNotNull())
        .groupBy(F.col("sale_date").alias("date"), "store_id")
        .agg(
            zero_sum(F.col("quantity")).alias("total_quantity"),
            money_sum(F.col("sale_amount")).alias("total_revenue"),
        )
    )


def _cost() -> Column:
    """Cost of the lines of a group, multiplied and summed exactly."""
    unit = F.col("unit_cost").cast(f"decimal(27,{PLACES})")
    return F.coalesce(F.sum(F.col("quantity").cast("decimal(10,0)") * unit), F.lit(0)).cast("double")


def daily_cost(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Cost of known products per (date, store), to two decimals."""
    cost = _cost()
    return (
        _by_product(sales)
        .join(_catalogue(products), "product_id")
        .groupBy(*DAY_KEY)
        .agg(round_even(cost).alias("total_cost"))
    )


def product_quantities(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Quantity per (date, store, product, name) over known products."""
    return (
        _by_product(sales)
        .join(_named_products(products).filter(F.col("name").isNotNull()), "product_id")
        .select(
            *DAY_KEY, "product_id", "name", (F.col("quantity") * F.col("copies")).alias("quantity")
        )
    )


def best_selling_ties(sales: DataFrame, products: DataFrame) -> DataFrame:
    """All products that reach the largest quantity of their (date, store).

    The maximum is an aggregate, joined back on its value too: the rows of a
    store-day spread over the quantities instead of meeting in one window.
    """
    quantities = product_quantities(sales, products)
    top = quantities.groupBy(*DAY_KEY).agg(F.max("quantity").alias("quantity"))
    return quantities.join(top, [*DAY_KEY, "quantity"]).select(
        *DAY_KEY,
        F.col("product_id").alias("best_selling_product_id"),
        F.col("name").alias("best_selling_product_name"),
        F.col("quantity").alias("max_quantity"),
    )


def best_selling(sales: DataFrame, products: DataFrame) -> DataFrame:
    """One best seller per (date, store): among ties the highest (id, name)."""
    top = F.max(F.struct("quantity", "product_id", "name"))
    return (
        product_quantities(sales, products)
        .groupBy(*DAY_KEY)
        .agg(top.alias("top"))
        .select(
            *DAY_KEY,
            F.col("top.product_id").alias("best_selling_product_id"),
            F.col("top.name").alias("best_selling_product_name"),
            F.col("top.quantity").alias("max_quantity"),
        )
    )


def sales_day(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Quantity, revenue, cost and best seller per (date, store) in one go.

    Same figures as ``daily_sales``, ``daily_cost`` and ``best_selling``. A
    left join keeps unknown products in quantity and revenue only. The best seller's name is
    looked up for the store-days, so that no name travels with the lines.
    """
    catalogue = _catalogue(products)
    sold = _by_product(sales).join(catalogue, "product_id", "left")
    top = F.struct((F.col("quantity") * F.col("label.copies")).alias("quantity"), F.col("product_id"))
    days = sold.groupBy(*DAY_KEY).agg(
        F.sum("quantity").alias("total_quantity"),
        from_cents(F.sum("cents"), F.sum("rest")).cast("double").alias("total_revenue"),
        round_even(_cost()).alias("total_cost"),
        F.max(F.when(F.col("label").isNotNull(), top))["product_id"].alias("best_selling_product_id"),
    )
    names = catalogue.select(
        F.col("product_id").alias("best_selling_product_id"), F.col("label.name").alias("best_selling_product_name")
    )
    return days.join(names, "best_selling_product_id", "left").select(
        *DAY_KEY, "total_quantity", "total_revenue", "total_cost", "best_selling_product_id", "best_selling_product_name"
    )
