"""Registered queries: every operator over the whole benchmark tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmeter.functions import dates
from shopmeter.operators import kpi, lookups, metrics, quality, rollups, sales, themes, traffic
from shopmeter.operators.themes import ANNUAL, DAILY, MONTHLY, QUARTERLY
from shopmeter.plans import daily, extract, reports
from shopmeter.registry import views
from shopmeter.schemas import PRODUCTS, RETAIL_DATA
from shopmeter.session import shared_folder
from shopmeter.sinks.merges import merge_days, write_merged_day
from shopmeter.sinks.upsert import upsert
from shopmeter.sources import incremental, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
# Non-additive and additive metrics shown by the registered calendar series.
SERIES = [
    "total_visitors",
    "total_transactions",
    "total_quantity",
    "total_revenue",
    "total_cost",
    "total_margin",
    "conversion_rate",
    "avg_transaction_value",
    "revenue_per_visitor",
    "margin_per_visitor",
]
AS_OF = dt.date(1998, 7, 15)


def present(df: DataFrame) -> DataFrame:
    """Comparable output: dates as text, whole numbers as long, doubles to six decimals."""
    forms = {
        T.DateType: "date_format({0}, 'yyyy-MM-dd') AS {0}",
        T.IntegerType: "CAST({0} AS BIGINT) AS {0}",
        # The added zero turns a negative zero into a plain one.
        T.DoubleType: "rint({0} * 1000000D) / 1000000D + 0D AS {0}",
    }
    return df.selectExpr(*[forms.get(type(f.dataType), "{0}").format(f.name) for f in df.schema])


def query(function: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(function(spark, sf_dir))

    run.__doc__ = function.__doc__
    QUERIES[function.__name__] = run
    return function


# Scans and lookups


@query
def scan_products(spark, sf_dir):
    return lookups.all_products(views.products(spark, sf_dir))


@query
def scan_stores(spark, sf_dir):
    return lookups.all_stores(views.stores(spark, sf_dir))


@query
def table_inventory(spark, sf_dir):
    return tables.table_counts(
        spark, {name: f"{sf_dir}/{name}.parquet" for name in views.TABLES}
    )


@query
def file_inventory(spark, sf_dir):
    """Records per file of the whole folder."""
    name = F.regexp_extract("file", "([^/]+)$", 1)
    return tables.file_inventory(spark, sf_dir).select(name.alias("file"), "records", "readable")


@query
def clients_by_city(spark, sf_dir):
    return lookups.clients_by_city(views.clients(spark, sf_dir), "aSiA")


@query
def distinct_cities(spark, sf_dir):
    return lookups.distinct_cities(views.clients(spark, sf_dir))


@query
def distinct_stores(spark, sf_dir):
    return lookups.distinct_stores(views.stores(spark, sf_dir))


@query
def sales_by_date_store(spark, sf_dir):
    return lookups.sales_by_date_store(views.sales(spark, sf_dir), "1998-02-25", "2")


@query
def sales_by_hour(spark, sf_dir):
    return lookups.sales_by_hour(views.sales(spark, sf_dir), "1998-02-25", "19")


@query
def traffic_by_date(spark, sf_dir):
    return lookups.traffic_by_date(views.traffic(spark, sf_dir), "1998-02-25")


@query
def traffic_by_date_store(spark, sf_dir):
    return lookups.traffic_by_date(views.traffic(spark, sf_dir), "1998-02-25", "2")


# Traffic


@query
def traffic_drop_null(spark, sf_dir):
    kept = traffic.drop_unmeasured(views.gappy_traffic(spark, sf_dir))
    # Counts with gaps as doubles: clients differ in how they show a missing whole number.
    return kept.withColumns({m: F.col(m).cast("double") for m in ("visitors", "sales")})


@query
def traffic_outlier_repair(spark, sf_dir):
    return traffic.repair_outliers(views.traffic(spark, sf_dir))


@query
def traffic_store_ratio(spark, sf_dir):
    return traffic.store_ratio(views.traffic(spark, sf_dir))


@query
def traffic_daily(spark, sf_dir):
    return traffic.daily_traffic_repaired(views.gappy_traffic(spark, sf_dir)).select(
        "date", "store_id", "total_visitors", "total_transactions"
    )


@query
def traffic_daily_inverse_rate(spark, sf_dir):
    return traffic.daily_traffic_repaired(
        views.traffic(spark, sf_dir), mode="inverse_rate"
    ).select("date", "store_id", "total_visitors", "total_transactions")


@query
def traffic_peak_hours(spark, sf_dir):
    return traffic.daily_traffic_repaired(views.traffic(spark, sf_dir)).select(
        "date", "store_id", "peak_hour_sales", "peak_hour_visitors"
    )


@query
def event_traffic_daily(spark, sf_dir):
    return traffic.daily_traffic(views.event_traffic(spark, sf_dir))


# Sales


@query
def sales_with_cost(spark, sf_dir):
    return sales.sales_with_cost(views.sales(spark, sf_dir), views.products(spark, sf_dir)).select(
        "sale_id", "product_id", "store_id", "sale_date", "quantity", "name", "cost", "total_cost"
    )


@query
def sales_daily(spark, sf_dir):
    return sales.daily_sales(views.sales(spark, sf_dir))


@query
def cost_daily(spark, sf_dir):
    return sales.daily_cost(views.sales(spark, sf_dir), views.products(spark, sf_dir))


@query
def product_quantity_daily(spark, sf_dir):
    return sales.product_quantities(views.sales(spark, sf_dir), views.products(spark, sf_dir))


@query
def best_selling_ties(spark, sf_dir):
    return sales.best_selling_ties(views.sales(spark, sf_dir), views.products(spark, sf_dir))


@query
def best_selling(spark, sf_dir):
    return sales.best_selling(views.sales(spark, sf_dir), views.products(spark, sf_dir))


# Merged days and metrics


@query
def daily_feeds_outer(spark, sf_dir):
    return daily.daily_feeds(
        views.traffic(spark, sf_dir), views.sales(spark, sf_dir), views.products(spark, sf_dir)
    )


@query
def moving_avg_4w(spark, sf_dir):
    new_traffic, new_sales, goods, published = views.split_batch(spark, sf_dir)
    days = daily.daily_feeds(new_traffic, new_sales, goods)
    return metrics.moving_averages(
        days, incremental.history_before(published, views.CUTOVER)
    ).select("date", "store_id", "day_of_week", *metrics.AVERAGES.values())


@query
def moving_avg_kept(spark, sf_dir):
    """The same averages from the last three rows of every store and weekday alone."""
    new_traffic, new_sales, goods, published = views.split_batch(spark, sf_dir)
    days = daily.daily_feeds(new_traffic, new_sales, goods)
    last = metrics.last_rows(published)
    return metrics.moving_averages(days, incremental.history_before(last, views.CUTOVER)).select(
        "date", "store_id", "day_of_week", *metrics.AVERAGES.values()
    )


@query
def metrics_last_rows(spark, sf_dir):
    return metrics.last_rows(views.metrics(spark, sf_dir))


@query
def final_metrics(spark, sf_dir):
    days = daily.daily_feeds(
        views.traffic(spark, sf_dir), views.sales(spark, sf_dir), views.products(spark, sf_dir)
    )
    return metrics.final_metrics(days).select(
        "date",
        "store_id",
        "conversion_rate",
        "avg_transaction_value",
        "revenue_per_visitor",
        "total_margin",
        "margin_per_visitor",
    )


@query
def daily_metrics(spark, sf_dir):
    return views.metrics(spark, sf_dir)


@query
def daily_metrics_incremental(spark, sf_dir):
    return views.incremental_metrics(spark, sf_dir)


# Incremental bookkeeping


@query
def processed_dates(spark, sf_dir):
    done = traffic.daily_traffic(views.traffic(spark, sf_dir)).filter(
        F.col("date") < F.lit(views.CUTOVER)
    )
    return incremental.processed_dates(done)


@query
def incremental_unprocessed(spark, sf_dir):
    feed = views.traffic(spark, sf_dir)
    done = traffic.daily_traffic(feed).filter(F.col("date") < F.lit(views.CUTOVER))
    return incremental.not_processed(feed, "date", incremental.processed_dates(done))


@query
def history_4w(spark, sf_dir):
    return incremental.history_before(
        traffic.daily_traffic(views.traffic(spark, sf_dir)), views.CUTOVER
    )


@query
def sales_day_merge(spark, sf_dir):
    lines = views.sales(spark, sf_dir)
    hour = F.substring("sale_time", 1, 2).cast("int")
    return merge_days(lines.filter(hour < 16), lines.filter(hour >= 12))


@query
def traffic_day_merge(spark, sf_dir):
    rows = views.traffic(spark, sf_dir)
    return merge_days(rows.filter(F.col("hour") < 16), rows.filter(F.col("hour") >= 12))


@query
def metrics_upsert(spark, sf_dir):
    days = traffic.daily_traffic(views.traffic(spark, sf_dir))
    day = F.col("date")
    existing = days.filter(day < F.lit(dt.date(1998, 7, 15)))
    new = days.filter(day >= F.lit(dt.date(1998, 6, 15))).withColumn(
        "total_visitors", F.col("total_visitors") + 1
    )
    return upsert(existing, new)


# Stored feeds, written to the shared folder and read back


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"


@query
def mixed_feed_read(spark, sf_dir):
    """Traffic in two parts: mornings with visitors as doubles and without sales, the rest complete."""
    rows, folder = views.traffic(spark, sf_dir), _folder(spark)
    morning = rows.filter("hour < 12").withColumn("visitors", F.col("visitors").cast("double")).drop("sales")
    morning.write.parquet(f"{folder}/a")
    rows.filter("hour >= 12").write.parquet(f"{folder}/b")
    return tables.read_mixed(spark, [f"{folder}/a", f"{folder}/b"], RETAIL_DATA)


@query
def json_feed_read(spark, sf_dir):
    """Traffic as JSON lines whose counts come as text or with a decimal point."""
    rows, folder = views.traffic(spark, sf_dir), _folder(spark)
    sent = rows.withColumns({"visitors": F.col("visitors").cast("double"), "sales": F.col("sales").cast("string")})
    sent.write.json(folder)
    return tables.drop_error_rows(tables.read_json_feed(spark, folder, RETAIL_DATA), ["store_id"])


@query
def alternating_days_read(spark, sf_dir):
    """Stored traffic whose visitors are doubles on every other day."""
    rows, folder = views.traffic(spark, sf_dir), _folder(spark)
    odd = F.dayofyear("date") % 2 == 1
    for part, kind in ((odd, "double"), (~odd, "long")):
        days = rows.filter(part).withColumn("visitors", F.col("visitors").cast(kind))
        days.repartition("date").write.mode("append").partitionBy("date").parquet(folder)
    return incremental.read_unprocessed(spark, folder, RETAIL_DATA, "date", [])


@query
def json_array_read(spark, sf_dir):
    """Traffic as JSON arrays, one file a store."""
    rows, folder = views.traffic(spark, sf_dir), _folder(spark)
    arrays = rows.groupBy("store_id").agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    arrays.repartition("store_id").write.partitionBy("store_id").option("maxRecordsPerFile", 1).text(folder)
    return tables.drop_error_rows(tables.read_json_feed(spark, f"{folder}/*", RETAIL_DATA, lines=False), ["store_id"])


@query
def snapshot_replace(spark, sf_dir):
    """The product snapshot, extracted from a feed of half the products and then from all."""
    goods, folder = views.products(spark, sf_dir), _folder(spark)
    goods.filter(F.length("name") % 2 == 0).write.json(f"{folder}/first")
    goods.write.json(f"{folder}/all")
    for feed in ("first", "all"):
        extract.extract_products(spark, f"{folder}/{feed}", f"{folder}/products")
    return tables.read_dataset(spark, f"{folder}/products", PRODUCTS)


@query
def registered_days(spark, sf_dir):
    """A table of the catalog over stored traffic: two days that the sink registered."""
    days, folder = [dt.date(1998, 2, 24), dt.date(1998, 2, 25)], _folder(spark)
    rows, name = views.traffic(spark, sf_dir), f"traffic_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in RETAIL_DATA.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY (`date`) LOCATION '{folder}'")
    for day in days:
        part = lookups.traffic_by_date(rows, day.isoformat())
        write_merged_day(spark, part, folder, RETAIL_DATA, "date", day, name)
    return spark.table(name)


@query
def cached_day(spark, sf_dir):
    """A stored day asked for through the cache, before and after a later extract is merged."""
    day, folder = dt.date(1998, 2, 25), _folder(spark)
    rows = lookups.traffic_by_date(views.traffic(spark, sf_dir), day.isoformat())
    for part in ("hour < 16", "hour >= 12"):
        write_merged_day(spark, rows.filter(part), folder, RETAIL_DATA, "date", day)
        found = tables.cached_table(spark, folder, RETAIL_DATA)
        found.count()
    return found


@query
def stored_day_merge(spark, sf_dir):
    """One stored day of traffic, merged with a later extract that overlaps it."""
    day, folder = dt.date(1998, 2, 25), _folder(spark)
    rows = lookups.traffic_by_date(views.traffic(spark, sf_dir), day.isoformat())
    for part in ("hour < 16", "hour >= 12"):
        write_merged_day(spark, rows.filter(part), folder, RETAIL_DATA, "date", day)
    return tables.read_days(spark, folder, RETAIL_DATA, "date", [day])


# Calendar series


@query
def series_daily(spark, sf_dir):
    return rollups.series_daily(views.metrics(spark, sf_dir), SERIES)


@query
def series_monthly(spark, sf_dir):
    return rollups.series_monthly(views.metrics(spark, sf_dir), SERIES)


@query
def series_annual(spark, sf_dir):
    return rollups.series_annual(views.metrics(spark, sf_dir), SERIES)


@query
def quarter_store_rollup(spark, sf_dir):
    return rollups.quarter_store_rollup(rollups.with_calendar(views.metrics(spark, sf_dir)))


@query
def series_quarterly(spark, sf_dir):
    rollup = rollups.quarter_store_rollup(views.metrics(spark, sf_dir))
    return rollups.series_quarterly(rollup, SERIES)


@query
def available_periods(spark, sf_dir):
    return rollups.available_periods(traffic.daily_traffic(views.traffic(spark, sf_dir)))


@query
def available_years(spark, sf_dir):
    return rollups.available_years(traffic.daily_traffic(views.traffic(spark, sf_dir)))


@query
def theme_series(spark, sf_dir):
    return reports.detail_page(
        views.metrics(spark, sf_dir), views.stores(spark, sf_dir),
        "Performance des visiteurs", DAILY, year=1998, month=7,
    )


@query
def theme_series_monthly(spark, sf_dir):
    return reports.detail_page(
        views.metrics(spark, sf_dir), views.stores(spark, sf_dir),
        "Efficacité des ventes", MONTHLY, store_name="NATION_7", year=1998,
    )


@query
def theme_series_quarterly(spark, sf_dir):
    return reports.detail_page(
        views.metrics(spark, sf_dir), views.stores(spark, sf_dir),
        "Indicateurs spécifiques par visiteur", QUARTERLY,
    )


@query
def theme_series_annual(spark, sf_dir):
    return reports.detail_page(
        views.metrics(spark, sf_dir), views.stores(spark, sf_dir), "Marges et coûts", ANNUAL
    )


@query
def theme_catalogue(spark, sf_dir):
    """Every theme's monthly series over all stores and dates."""
    names = [name for group in themes.themes(MONTHLY).values() for name in group]
    wide = themes.series(views.metrics(spark, sf_dir), MONTHLY, names)
    return wide.unpivot("x", names, "metric", "y").select("metric", "x", "y")


# Labels


def _trading_days(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("date")
    ).distinct()


@query
def weekday_label(spark, sf_dir):
    day = F.col("date")
    return _trading_days(spark, sf_dir).select(
        "date",
        dates.weekday_name(day).alias("day_of_week"),
        dates.weekday_rank(day).alias("weekday_rank"),
    )


@query
def quarter_label(spark, sf_dir):
    day = F.col("date")
    return _trading_days(spark, sf_dir).select(
        "date",
        dates.quarter_label(day).alias("quarter"),
        dates.quarter_rank(day).alias("quarter_for_sort"),
    )


@query
def month_label(spark, sf_dir):
    name = dates.month_name(F.month("date"))
    return _trading_days(spark, sf_dir).select(
        "date", name.alias("month_name"), dates.month_number(name).alias("month")
    )


# KPIs


@query
def metrics_slice_month(spark, sf_dir):
    return kpi.month_slice(views.metrics(spark, sf_dir), 1998, 7).select(
        "date", "store_id", "total_visitors", "total_revenue"
    )


@query
def metrics_date_coerce(spark, sf_dir):
    days = traffic.daily_traffic(views.traffic(spark, sf_dir))
    text = F.when(F.col("store_id") == "7", F.lit("bad")).otherwise(
        F.date_format("date", "yyyy-MM-dd")
    )
    return kpi.with_valid_dates(days.withColumn("date", text))


@query
def metrics_for_store_name(spark, sf_dir):
    return lookups.metrics_for_store_name(
        views.metrics(spark, sf_dir), views.stores(spark, sf_dir), "NATION_7"
    ).select("date", "store_id", "total_visitors", "total_revenue")


@query
def kpi_totals(spark, sf_dir):
    return kpi.kpi_totals(kpi.month_slice(views.metrics(spark, sf_dir), 1998, 7))


@query
def kpi_all_time(spark, sf_dir):
    return kpi.kpi_totals(views.metrics(spark, sf_dir))


@query
def kpi_month_to_date(spark, sf_dir):
    return kpi.kpi_totals(
        kpi.month_slice(views.metrics(spark, sf_dir), 1998, 7, as_of=AS_OF)
    )


@query
def kpi_previous_month_to_date(spark, sf_dir):
    return kpi.kpi_totals(
        kpi.previous_slice(views.metrics(spark, sf_dir), 1998, 7, as_of=AS_OF)
    )


@query
def kpi_variations(spark, sf_dir):
    return kpi.kpi_variations(views.metrics(spark, sf_dir), 1998, 7)


@query
def kpi_variations_january(spark, sf_dir):
    return kpi.kpi_variations(views.metrics(spark, sf_dir), 1998, 1)


@query
def kpi_variations_to_date(spark, sf_dir):
    return kpi.kpi_variations(views.metrics(spark, sf_dir), 1998, 7, as_of=AS_OF)


# Reconciliation and quality


@query
def baskets_per_store(spark, sf_dir):
    return quality.baskets_per_store(views.sales(spark, sf_dir))


@query
def open_hours_sales(spark, sf_dir):
    return quality.open_hours_sales(views.traffic(spark, sf_dir), views.stores(spark, sf_dir))


@query
def reconcile_sales_traffic(spark, sf_dir):
    return quality.reconcile_sales_traffic(
        views.sales(spark, sf_dir), views.traffic(spark, sf_dir), views.stores(spark, sf_dir)
    )


@query
def dq_closed_hours(spark, sf_dir):
    return quality.closed_hours(views.traffic(spark, sf_dir), views.flawed_stores(spark, sf_dir))


@query
def dq_over_capacity(spark, sf_dir):
    return quality.over_capacity(views.traffic(spark, sf_dir), views.flawed_stores(spark, sf_dir))


@query
def dq_traffic_profile(spark, sf_dir):
    return quality.traffic_profile(views.gappy_traffic(spark, sf_dir))


@query
def dq_line_amount(spark, sf_dir):
    return quality.line_amount_errors(views.priced_sales(spark, sf_dir), views.products(spark, sf_dir))


@query
def dq_basket_size(spark, sf_dir):
    return quality.basket_size_errors(views.sales(spark, sf_dir))


@query
def dq_client_city(spark, sf_dir):
    return quality.client_city_errors(
        views.sales(spark, sf_dir),
        views.clients(spark, sf_dir).filter(F.col("id").cast("long") % 10 != 0),
        views.flawed_stores(spark, sf_dir),
    )


@query
def dq_client_age(spark, sf_dir):
    return quality.unrealistic_ages(views.clients(spark, sf_dir))


@query
def dq_feed_errors(spark, sf_dir):
    """A feed in which orders of one priority arrive as error messages."""
    feed = views.sales(spark, sf_dir).withColumn(
        "error", F.when(F.col("nb_type_product") == 5, F.lit("no sales found"))
    )
    return quality.feed_quality(feed, ["sale_id", "store_id"])
