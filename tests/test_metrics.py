import datetime as dt
import random
import re
from decimal import Decimal

import pytest

from shopmeter.operators import metrics as ops
from shopmeter.operators.sales import sales_day
from shopmeter.operators.traffic import daily_traffic_repaired
from shopmeter.plans import daily
from tests.conftest import records

DAYS = "date string, store_id string, total_transactions int, total_visitors int, total_revenue int"


def mondays(values, store="store_1", first="2023-11-06"):
    start = dt.date.fromisoformat(first)
    return [
        ((start + dt.timedelta(weeks=i)).isoformat(), store, v, v * 10, v * 100)
        for i, v in enumerate(values)
    ]


def averages(df):
    return [
        (r["avg_sales_last_4_weeks"], r["avg_visitors_last_4_weeks"], r["avg_revenue_last_4_weeks"])
        for r in records(df, "date", "store_id")
    ]


def test_average_over_history_and_batch(frame):
    history = frame(DAYS, mondays([10, 20, 30]))
    batch = frame(DAYS, mondays([10, 20, 30, 40])[3:])
    assert averages(ops.moving_averages(batch, history)) == [(25.0, 250.0, 2500.0)]


def test_fifth_row_drops_the_first(frame):
    batch = frame(DAYS, mondays([10, 20, 30, 40, 50]))
    assert [a[0] for a in averages(ops.moving_averages(batch))] == [10.0, 15.0, 20.0, 25.0, 35.0]


def test_frame_counts_rows_not_weeks_and_separates_weekdays_and_stores(frame):
    batch = frame(DAYS, [
        ("2023-11-06", "a", 10, 1, 1), ("2023-12-25", "a", 30, 1, 1), ("2023-12-26", "a", 99, 1, 1),
        ("2023-12-25", "b", 50, 1, 1),
    ])
    assert [a[0] for a in averages(ops.moving_averages(batch))] == [10.0, 20.0, 50.0, 99.0]


def test_missing_values_are_skipped(frame):
    rows = [("2023-11-06", "a", 10, None, 1), ("2023-11-13", "a", None, None, 2)]
    assert averages(ops.moving_averages(frame(DAYS, rows))) == [(10.0, None, 1.0), (10.0, None, 1.5)]


def test_average_of_money_rounds_half_to_even(frame):
    schema = DAYS.replace("total_revenue int", "total_revenue double")
    rows = [(day, s, 1, 1, r) for (day, s, *_), r in zip(mondays([1, 1, 1, 1]), [25.01, 25.01, 25.0, 25.0])]
    assert averages(ops.moving_averages(frame(schema, rows)))[3][2] == 25.0


FINAL = (
    "total_transactions int, total_visitors int, total_revenue int, total_cost int, "
    "avg_visitors_last_4_weeks int, avg_sales_last_4_weeks int, avg_revenue_last_4_weeks int"
)


def test_final_metrics(frame):
    df = frame(FINAL, [
        (10, 100, 1000, 500, 90, 8, 950), (20, 200, 2500, 1500, 180, 18, 2400), (0, 0, 0, 0, 100, 5, 500),
    ])
    rows = records(ops.final_metrics(df), "total_transactions")
    rows = [rows[1], rows[2], rows[0]]

    def column(name):
        return [None if r[name] is None else pytest.approx(r[name], abs=1e-4) for r in rows]

    assert column("conversion_rate") == [10, 10, None]
    assert column("avg_transaction_value") == [100, 125, None]
    assert column("revenue_per_visitor") == [10, 12.5, None]
    assert column("total_margin") == [500, 1000, 0]
    assert column("margin_per_visitor") == [5, 5, None]
    assert column("visitors_variation_vs_avg_4w_percent") == [11.1111, 11.1111, -100]
    assert column("revenue_variation_vs_avg_4w_percent") == [5.2632, 4.1667, -100]
    assert column("transactions_variation_vs_avg_4w_percent") == [25, 11.1111, -100]
    assert column("transactions_amount_variation_vs_avg_4w_percent") == [-15.7895, -6.25, None]


def test_final_metrics_without_averages_or_values(frame):
    df = frame("total_transactions int, total_visitors int, total_revenue int, total_cost int", [
        (10, 100, 1000, 500), (None, None, None, None),
    ])
    rows = records(ops.final_metrics(df), "total_transactions")
    assert rows[0]["conversion_rate"] == 10 and rows[0]["avg_sales_last_4_weeks"] is None
    for name in ("conversion_rate", "avg_transaction_value", "revenue_per_visitor", "total_margin"):
        assert rows[1][name] is None
    assert rows[0]["visitors_variation_vs_avg_4w_percent"] is None


def test_zero_average_gives_null_not_infinity(frame):
    df = frame(FINAL, [(1, 1, 1, 1, 0, 0, 0)])
    (row,) = records(ops.final_metrics(df), "total_cost")
    assert row["visitors_variation_vs_avg_4w_percent"] is None
    assert row["transactions_amount_variation_vs_avg_4w_percent"] is None


TRAFFIC = "date string, store_id string, hour int, visitors int, sales int"
LINES = "sale_date string, store_id string, product_id string, quantity int, sale_amount double"
GOODS = "id string, name string, cost double"


def test_store_days_of_either_feed_survive(frame):
    traffic = frame(TRAFFIC, [("2023-12-01", "a", 14, 100, 50), ("2023-12-01", "b", 9, 10, 0)])
    lines = frame(LINES, [("2023-12-01", "a", "p", 10, 500.0), ("2023-12-02", "a", "p", 1, 50.0)])
    goods = frame(GOODS, [("p", "P", 10.0)])
    first, other, late = records(daily.daily_metrics(traffic, lines, goods), "date", "store_id")
    assert (first["total_revenue"], first["total_cost"], first["total_margin"]) == (500, 100, 400)
    assert (first["conversion_rate"], first["avg_transaction_value"]) == (50, 10)
    assert (first["peak_hour_sales"], first["day_of_week"]) == (14, "Friday")
    assert (other["total_revenue"], other["best_selling_product_id"]) == (0, None)
    assert (late["total_visitors"], late["conversion_rate"], late["peak_hour_sales"]) == (0, None, 0)
    assert late["best_selling_product_name"] == "P"


def test_merging_before_the_repair_equals_merging_after(frame):
    traffic = frame(TRAFFIC, [
        ("2023-12-01", "a", 9, 100, 10), ("2023-12-01", "a", 10, 9000, 12),
        ("2023-12-02", "a", 11, 7000, 5), ("2023-12-01", "b", 9, 8000, 3),
    ])
    lines = frame(LINES, [("2023-12-03", "a", "p", 1, 5.0), ("2023-12-03", "c", "p", 1, 5.0)])
    goods = frame(GOODS, [("p", "P", 1.0)])
    fused = daily.daily_feeds(traffic, lines, goods)
    stepwise = ops.fill_missing(
        daily_traffic_repaired(traffic).join(sales_day(lines, goods), ["date", "store_id"], "full_outer")
    )
    assert records(fused, "date", "store_id") == records(stepwise.select(*fused.columns), "date", "store_id")
    assert [r["total_visitors"] for r in records(fused, "date", "store_id")] == [220, 8000, 50, 0, 0]


def test_plan_of_the_daily_job(spark, frame, tmp_path):
    """Needed columns only, one shuffle per aggregate, one by store, none by weekday."""
    traffic = frame(TRAFFIC + ", store_name string", [("2023-12-01", "a", 9, 100, 10, "A")])
    lines = frame(LINES + ", client_id string", [("2023-12-01", "a", "p", 1, 5.0, "c")])
    goods = frame(GOODS + ", category string", [("p", "P", 1.0, "x")])
    paths = {}
    for name, df in (("traffic", traffic), ("lines", lines), ("goods", goods)):
        paths[name] = str(tmp_path / name)
        df.write.parquet(paths[name])
    read = {name: spark.read.parquet(path) for name, path in paths.items()}
    df = daily.daily_metrics(read["traffic"], read["lines"], read["goods"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "store_name" not in plan and "client_id" not in plan and "category" not in plan
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)
    keys = sorted(re.sub(r"#\d+", "", keys) for keys in shuffles)
    assert keys == [
        "date, store_id", "date, store_id", "product_id", "product_id, name", "sale_date, store_id, product_id", "store_id",
    ]


@pytest.mark.parametrize("seed", range(3))
def test_averages_equal_a_plain_loop(frame, seed):
    rng = random.Random(seed)
    start = dt.date(2024, 1, 1)
    rows = []
    for store in "abc":
        for i in range(70):
            if rng.random() < 0.8:
                rows.append((
                    (start + dt.timedelta(days=i)).isoformat(), store,
                    rng.choice([None, rng.randint(0, 50)]), rng.randint(0, 900),
                    rng.randint(0, 10**7) / 100,
                ))
    cut = (start + dt.timedelta(days=35)).isoformat()
    expected = {}
    for day, store, *_ in rows:
        if day < cut:
            continue
        weekday = dt.date.fromisoformat(day).weekday()
        past = sorted(
            r for r in rows
            if r[1] == store and r[0] <= day and dt.date.fromisoformat(r[0]).weekday() == weekday
        )[-4:]
        means = []
        for column in (2, 3, 4):
            values = [Decimal(str(r[column])) for r in past if r[column] is not None]
            means.append(float(sum(values) / len(values)) if values else None)
        expected[day, store] = [m if m is None else round(m * 100) / 100 for m in means]
    rng.shuffle(rows)
    schema = DAYS.replace("total_revenue int", "total_revenue double")
    everything = frame(schema, rows)
    result = ops.moving_averages(everything.filter(f"date >= '{cut}'"), everything.filter(f"date < '{cut}'"))
    found = {
        (r["date"], r["store_id"]): [
            r["avg_sales_last_4_weeks"], r["avg_visitors_last_4_weeks"], r["avg_revenue_last_4_weeks"]
        ]
        for r in records(result, "date", "store_id")
    }
    assert found == expected
