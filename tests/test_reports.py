import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shopmeter.functions import dates
from shopmeter.operators import kpi, lookups, rollups, themes
from shopmeter.plans import reports
from tests.conftest import records

NAMES = [
    "total_visitors", "total_transactions", "total_quantity", "total_revenue", "total_cost",
    "total_margin", "avg_revenue_last_4_weeks", "avg_visitors_last_4_weeks",
    "avg_sales_last_4_weeks", "conversion_rate", "avg_transaction_value", "revenue_per_visitor",
    "margin_per_visitor", "visitors_variation_vs_avg_4w_percent",
]
SCHEMA = "date string, store_id string, " + ", ".join(f"{n} double" for n in NAMES)


def build(frame, rows):
    """Rows of (date, store, visitors, transactions, revenue, cost)."""
    full = []
    for day, store, visitors, sales, revenue, cost in rows:
        values = dict.fromkeys(NAMES)
        values.update(
            total_visitors=visitors, total_transactions=sales, total_quantity=2.0,
            total_revenue=revenue, total_cost=cost, total_margin=revenue - cost,
            avg_visitors_last_4_weeks=visitors / 2,
            conversion_rate=100 * sales / visitors if visitors else None,
            avg_transaction_value=revenue / sales if sales else None,
            revenue_per_visitor=revenue / visitors if visitors else None,
        )
        full.append((day, store, *[values[n] for n in NAMES]))
    return frame(SCHEMA, full)


@pytest.fixture
def metrics(frame):
    return build(frame, [
        ("2023-12-31", "a", 50.0, 5.0, 100.0, 40.0),
        ("2024-01-05", "a", 100.0, 10.0, 1000.0, 500.0),
        ("2024-01-20", "a", 300.0, 60.0, 3000.0, 500.0),
        ("2024-01-05", "b", 200.0, 10.0, 500.0, 100.0),
        ("2024-02-01", "b", 0.0, 0.0, 0.0, 0.0),
        ("2024-04-01", "b", 10.0, 1.0, 10.0, 1.0),
    ])


STORES = "id string, name string"


@pytest.fixture
def stores(frame):
    return frame(STORES, [("a", "Store A"), ("b", "Store B")])


def test_daily_series_sums_or_averages(metrics):
    rows = records(rollups.series_daily(metrics, ["total_visitors", "conversion_rate"]), "date")
    day = next(r for r in rows if r["date"] == "2024-01-05")
    assert (day["total_visitors"], day["conversion_rate"]) == (300.0, 7.5)
    empty = next(r for r in rows if r["date"] == "2024-02-01")
    assert (empty["total_visitors"], empty["conversion_rate"]) == (0.0, None)


def test_longer_periods_reweigh_the_ratios(metrics):
    names = ["total_revenue", "conversion_rate", "avg_transaction_value", "revenue_per_visitor"]
    months = records(rollups.series_monthly(metrics, names), "month_start")
    assert [m["month_start"] for m in months] == [
        "2023-12-01", "2024-01-01", "2024-02-01", "2024-04-01",
    ]
    assert months[1]["conversion_rate"] == pytest.approx(100 * 80 / 600)
    assert months[1]["avg_transaction_value"] == pytest.approx(4500 / 80)
    assert months[1]["revenue_per_visitor"] == pytest.approx((10 + 10 + 2.5) / 3)
    assert months[2]["conversion_rate"] is None
    years = records(rollups.series_annual(metrics, names), "year")
    assert [(y["year"], y["total_revenue"]) for y in years] == [(2023, 100.0), (2024, 4510.0)]


def test_quarterly_means_are_means_of_store_means(metrics):
    rollup = rollups.quarter_store_rollup(rollups.with_calendar(metrics))
    rows = records(rollup, "quarter", "store_id")
    assert [(r["quarter"], r["store_id"]) for r in rows] == [
        ("2023-Q4", "a"), ("2024-Q1", "a"), ("2024-Q1", "b"), ("2024-Q2", "b"),
    ]
    assert rows[1]["revenue_per_visitor"] == 10.0 and rows[1]["month"] == 1.0
    names = ["total_visitors", "revenue_per_visitor", "conversion_rate"]
    quarters = records(rollups.series_quarterly(rollup, names), "quarter_for_sort")
    first = quarters[1]
    assert first["quarter"] == "2024-Q1"
    assert first["revenue_per_visitor"] == (10.0 + 2.5) / 2
    assert first["conversion_rate"] == pytest.approx(100 * 80 / 600)
    assert rollups.averaged_columns(metrics)[0] == "avg_transaction_value"


def test_available_periods(metrics):
    assert records(rollups.available_periods(metrics), "year", "month")[0] == {
        "year": 2023, "month": 12,
    }
    assert [r["year"] for r in rollups.available_years(metrics, descending=True).collect()] == [2024, 2023]
    assert [r["year"] for r in rollups.available_years(metrics).collect()] == [2023, 2024]


def test_themes_per_period():
    daily, monthly = themes.themes(themes.DAILY), themes.themes(themes.MONTHLY)
    assert len(daily) == len(monthly) == 6
    assert daily["Performance des visiteurs"] == [
        "total_visitors", "avg_visitors_last_4_weeks", "visitors_variation_vs_avg_4w_percent",
    ]
    assert monthly["Performance des visiteurs"] == ["total_visitors"]
    assert set(daily["Quantité et revenus"]) == {
        "total_quantity", "total_revenue", "avg_revenue_last_4_weeks",
        "revenue_variation_vs_avg_4w_percent",
    }
    assert set(monthly["Quantité et revenus"]) == {"total_quantity", "total_revenue"}


def test_detail_page(metrics, stores):
    rows = records(
        reports.detail_page(metrics, stores, "Efficacité des ventes", themes.MONTHLY, "Store A", 2024),
        "metric", "x",
    )
    assert [(r["metric"], r["x"]) for r in rows] == [
        ("avg_transaction_value", "2024-01-01"), ("conversion_rate", "2024-01-01"),
    ]
    assert rows[1]["y"] == pytest.approx(17.5)
    daily = reports.detail_page(
        metrics, stores, "Performance des visiteurs", themes.DAILY, year=2024, month=1
    )
    assert daily.count() == 6
    with pytest.raises(ValueError):
        reports.detail_page(metrics, stores, "Marges et coûts", themes.MONTHLY)
    with pytest.raises(ValueError):
        reports.detail_page(metrics, stores, "Marges et coûts", themes.DAILY, year=2024)
    with pytest.raises(ValueError):
        reports.detail_page(metrics, stores, "inconnu", themes.ANNUAL)
    with pytest.raises(ValueError):
        themes.series(metrics, "Hebdomadaire", ["total_cost"])


def test_kpi_page(metrics, stores):
    totals, changes = reports.kpi_page(metrics, stores, 2024, 1, "Store A")
    (row,) = records(totals, "total_cost")
    assert (row["total_visitors"], row["total_transactions"], row["total_margin"]) == (400, 70, 3000)
    assert row["conversion_rate"] == 17.5 and row["revenue_millions"] == 0.004
    (change,) = records(changes, "total_cost")
    assert change["total_visitors"] == 700.0 and change["total_cost"] == pytest.approx(2400.0)
    assert change["conversion_rate"] == pytest.approx(75.0)


def test_kpis_of_nothing_and_zero_bases(metrics):
    (empty,) = records(kpi.kpi_totals(kpi.month_slice(metrics, 2030, 1)), "total_cost")
    assert set(empty.values()) == {0.0}
    for year, month in ((2030, 1), (2023, 12)):
        (row,) = records(kpi.kpi_variations(metrics, year, month), "total_cost")
        assert set(row.values()) == {None}
    (row,) = records(kpi.kpi_variations(metrics, 2024, 2), "total_cost")
    assert row["total_revenue"] == -100.0
    back = kpi.kpi_variations(metrics.withColumn("date", F.date_add("date", -29)), 2024, 2)
    assert records(back, "total_cost")[0]["total_cost"] is None


def test_month_to_date_cuts_both_months(frame):
    rows = build(frame, [
        ("2024-01-10", "a", 10.0, 1.0, 100.0, 10.0), ("2024-01-25", "a", 90.0, 1.0, 900.0, 10.0),
        ("2023-12-10", "a", 5.0, 1.0, 50.0, 10.0), ("2023-12-25", "a", 95.0, 1.0, 900.0, 10.0),
    ])
    as_of = dt.date(2024, 1, 15)
    (totals,) = records(kpi.kpi_totals(kpi.month_slice(rows, 2024, 1, as_of=as_of)), "total_cost")
    assert totals["total_visitors"] == 10.0
    (before,) = records(kpi.kpi_totals(kpi.previous_slice(rows, 2024, 1, as_of=as_of)), "total_cost")
    assert before["total_visitors"] == 5.0
    (change,) = records(kpi.kpi_variations(rows, 2024, 1, as_of=as_of), "total_cost")
    assert change["total_visitors"] == 100.0
    (closed,) = records(kpi.kpi_variations(rows, 2024, 1, as_of=dt.date(2024, 3, 1)), "total_cost")
    assert closed["total_visitors"] == 0.0


def test_date_filters_prune_partitions(spark, metrics, tmp_path):
    metrics.write.partitionBy("date").parquet(str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    for df in (kpi.month_slice(stored, 2024, 1), kpi.kpi_variations(stored, 2024, 1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(date" in plan or "PartitionFilters: [((" in plan


def test_unreadable_dates_are_dropped(frame):
    rows = frame("date string, store_id string", []).sparkSession.createDataFrame(
        [("2024-01-01", "a"), ("bad", "b"), ("2024-02-30", "c"), (None, "d")], "date string, store_id string"
    )
    assert [r["store_id"] for r in records(kpi.with_valid_dates(rows), "store_id")] == ["a"]


def test_sums_do_not_depend_on_row_order(frame):
    rng = random.Random(7)
    rows = [("2024-01-01", f"s{i}", rng.uniform(0, 1e7), 1.0, rng.uniform(0, 1e5), 1.0) for i in range(200)]
    one = kpi.kpi_totals(build(frame, rows))
    other = kpi.kpi_totals(build(frame, sorted(rows, key=lambda r: r[2])).repartition(5))
    assert records(one, "total_cost") == records(other, "total_cost")


def test_labels(frame):
    days = frame("date string", [("2024-02-26",), ("2024-03-03",)])
    rows = records(days.select(
        "date", dates.weekday_name(days.date).alias("name"), dates.weekday_rank(days.date).alias("rank"),
        dates.quarter_label(days.date).alias("quarter"), dates.is_weekend(days.date).alias("weekend"),
        dates.month_name(F.month(days.date)).alias("month"),
        dates.month_number(dates.month_name(F.month(days.date))).alias("number"),
    ), "date")
    assert [tuple(r.values())[1:] for r in rows] == [
        ("Monday", 0, "2024-Q1", False, "Février", 2), ("Sunday", 6, "2024-Q1", True, "Mars", 3),
    ]
    odd = frame("m int, n string", [(13, "Nivôse")])
    assert odd.select(dates.month_name(odd.m), dates.month_number(odd.n)).first()[:] == (None, None)


@pytest.mark.parametrize("text", ["2023/12/01", "01-12-2023", "2023-13-01", ""])
def test_malformed_day_parameters(text):
    with pytest.raises(ValueError):
        dates.parse_day(text)


def test_lookups(frame, stores, metrics):
    clients = frame("id string, city string", [("1", "Paris"), ("2", "Lyon"), ("3", None)])
    assert [r["id"] for r in records(lookups.clients_by_city(clients, "PARIS"), "id")] == ["1"]
    assert lookups.clients_by_city(clients, "Nowhere").isEmpty()
    assert lookups.distinct_cities(clients).count() == 2
    sales = frame("sale_id string, store_id string, sale_date string, sale_time string", [
        ("1", "1", "2023-12-01", "14:05:00"), ("2", "2", "2023-12-01", "15:00:00"),
        ("3", "1", "2023-12-02", "14:00:00"), ("4", "1", "2023-12-01", "xx"),
    ])
    found = records(lookups.sales_by_date_store(sales, "2023-12-01", "1"), "sale_id")
    assert [r["sale_id"] for r in found] == ["1", "4"]
    assert [r["sale_id"] for r in records(lookups.sales_by_hour(sales, "2023-12-01", "14"), "sale_id")] == ["1"]
    assert lookups.sales_by_hour(sales, "2023-12-01", 9).isEmpty()
    traffic = frame("store_id string, date string", [("1", "2023-12-01"), ("2", "2023-12-01")])
    assert lookups.traffic_by_date(traffic, "2023-12-01").count() == 2
    assert lookups.traffic_by_date(traffic, "2023-12-01", "1").count() == 1
    assert lookups.traffic_by_date(traffic, "2023-12-02", "1").isEmpty()
    with pytest.raises(ValueError):
        lookups.traffic_by_date(traffic, "invalid-date")
    assert lookups.metrics_for_store_name(metrics, stores, "Store B").count() == 3
    assert lookups.metrics_for_store_name(metrics, stores).count() == 6
    assert lookups.metrics_for_store_name(metrics, stores, "x").isEmpty()
