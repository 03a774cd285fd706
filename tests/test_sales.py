import random
from collections import defaultdict

import pytest

from shopmeter.operators import sales as ops
from tests.conftest import records

LINES = "sale_date string, store_id string, product_id string, quantity int, sale_amount double"
GOODS = "id string, name string, cost double"


@pytest.fixture
def feed(frame):
    return frame(LINES, [
        ("2023-12-01", "store_1", "prod_1", 10, 100.5),
        ("2023-12-01", "store_1", "prod_2", 20, 200.25),
        ("2023-12-02", "store_2", "prod_3", 15, 30.0),
        ("2023-12-02", "store_2", "unknown", 99, 70.0),
        (None, "store_2", "prod_3", 1, 1.0),
        ("2023-12-02", None, "prod_3", 1, 1.0),
    ])


@pytest.fixture
def goods(frame):
    return frame(GOODS, [
        ("prod_1", "Product A", 1.5), ("prod_2", "Product B", 2.0), ("prod_3", "Product C", 0.333),
    ])


def test_best_seller(feed, goods):
    for result in (ops.best_selling(feed, goods), ops.best_selling_ties(feed, goods)):
        rows = records(result, "date")
        assert [r["best_selling_product_name"] for r in rows] == ["Product B", "Product C"]
        assert [r["max_quantity"] for r in rows] == [20, 15]


def test_best_seller_ties(frame, goods):
    lines = frame(LINES, [
        ("2023-12-01", "s", "prod_1", 12, 1.0),
        ("2023-12-01", "s", "prod_1", 8, 1.0),
        ("2023-12-01", "s", "prod_2", 20, 1.0),
        ("2023-12-01", "s", "prod_3", 5, 1.0),
    ])
    ties = records(ops.best_selling_ties(lines, goods), "best_selling_product_id")
    assert [r["best_selling_product_id"] for r in ties] == ["prod_1", "prod_2"]
    (one,) = records(ops.best_selling(lines, goods), "date")
    assert one["best_selling_product_id"] == "prod_2"


def test_unknown_products_count_in_revenue_only(feed, goods):
    days = records(ops.sales_day(feed, goods), "date")
    assert [d["total_quantity"] for d in days] == [30, 114]
    assert [d["total_revenue"] for d in days] == [300.75, 100.0]
    assert [d["total_cost"] for d in days] == [55.0, 5.0]
    assert days[1]["best_selling_product_id"] == "prod_3"
    assert {r["product_id"] for r in records(ops.sales_with_cost(feed, goods), "product_id")} == {
        "prod_1", "prod_2", "prod_3",
    }


def test_day_without_a_known_product(frame, goods):
    lines = frame(LINES, [("2023-12-01", "s", "unknown", 3, 9.99), ("2023-12-01", "s", None, 1, 1.0)])
    (day,) = records(ops.sales_day(lines, goods), "date")
    assert day == {
        "date": "2023-12-01", "store_id": "s", "total_quantity": 4, "total_revenue": 10.99,
        "total_cost": 0.0, "best_selling_product_id": None, "best_selling_product_name": None,
    }
    assert ops.daily_cost(lines, goods).isEmpty()


def test_cost_rounds_half_to_even(frame):
    goods = frame(GOODS, [("a", "A", 0.125), ("b", "B", 0.375)])
    lines = frame(LINES, [("2023-12-01", "s", "a", 1, 1.0), ("2023-12-02", "s", "b", 1, 1.0)])
    assert [d["total_cost"] for d in records(ops.daily_cost(lines, goods), "date")] == [0.12, 0.38]


def test_missing_and_nan_amounts_count_as_nothing(frame, goods):
    lines = frame(LINES, [
        ("2023-12-01", "s", "prod_1", None, 5.0),
        ("2023-12-01", "s", "prod_1", 2, float("nan")),
        ("2023-12-01", "s", "prod_1", 2, None),
    ])
    (day,) = records(ops.daily_sales(lines), "date")
    assert (day["total_quantity"], day["total_revenue"]) == (4, 5.0)


@pytest.mark.parametrize("seed", range(3))
def test_one_pass_equals_the_separate_operators_on_repeated_product_ids(frame, seed):
    """Against a nested-loop join, with repeated ids, names and unknown products."""
    rng = random.Random(seed)
    goods = [
        (f"p{rng.randint(0, 4)}", rng.choice(["A", "B", None]), rng.choice([0.5, 1.25, None]))
        for _ in range(8)
    ]
    lines = [
        (f"2024-01-0{rng.randint(1, 3)}", rng.choice("xy"), f"p{rng.randint(0, 6)}",
         rng.randint(1, 4), rng.randint(1, 999) / 100)
        for _ in range(80)
    ]
    revenue, cost, sold = defaultdict(float), defaultdict(float), defaultdict(int)
    for day, store, product, quantity, amount in lines:
        revenue[day, store] += amount
        for known, name, price in goods:
            if known == product:
                cost[day, store] += quantity * (price or 0)
                if name is not None:
                    sold[day, store, product, name] += quantity
    best = {}
    for (day, store, product, name), quantity in sold.items():
        best[day, store] = max(best.get((day, store), (0,)), (quantity, product, name))
    sales, products = frame(LINES, lines), frame(GOODS, goods)
    for row in records(ops.sales_day(sales, products), "date"):
        key = row["date"], row["store_id"]
        assert row["total_revenue"] == pytest.approx(revenue[key], abs=1e-9)
        assert row["total_cost"] == pytest.approx(cost[key], abs=0.0051)
        assert (row["best_selling_product_id"], row["best_selling_product_name"]) == best[key][1:]
    for row in records(ops.best_selling(sales, products), "date"):
        assert row["max_quantity"] == best[row["date"], row["store_id"]][0]
    quantities = {
        (r["date"], r["store_id"], r["product_id"], r["name"]): r["quantity"]
        for r in records(ops.product_quantities(sales, products), "date")
    }
    assert quantities == dict(sold)


def test_best_seller_needs_no_window(feed, goods):
    """A window would gather a whole store-day in one task."""
    for result in (ops.best_selling(feed, goods), ops.best_selling_ties(feed, goods)):
        assert "Window" not in result._jdf.queryExecution().optimizedPlan().toString()


def test_small_and_large_amounts_are_not_cut(frame):
    lines = frame(LINES, [("2023-12-01", "s", "p", 100_000, 0.00004)] * 10 + [("2023-12-01", "t", "p", 1, 9.0e13)])
    goods = frame(GOODS, [("p", "P", 0.00004)])
    whole = records(ops.daily_cost(lines, goods), "store_id")
    assert whole[0]["total_cost"] == 40.0
    days = records(ops.daily_sales(lines), "store_id")
    assert [r["total_revenue"] for r in days] == [0.0004, 9.0e13]
    assert [(r["total_cost"], r["total_revenue"]) for r in records(ops.sales_day(lines, goods), "store_id")][0] == (40.0, 0.0004)


def test_amounts_of_any_kind_add_up_exactly(frame):
    from decimal import Decimal
    from random import Random

    draw = Random(3)
    kinds = [lambda: draw.randrange(10**9) / 100, lambda: -draw.randrange(999) / 100, lambda: draw.random(), lambda: 0.29,
             lambda: 1e8, lambda: 99999999.99, lambda: 1e14 + 0.125, lambda: float("nan"), lambda: None, lambda: -0.0, lambda: 1e-9]
    lines = [("2023-12-01", draw.choice("ab"), draw.choice("pq"), 1, draw.choice(kinds)()) for _ in range(800)]
    expected = {}
    for _, store, _, _, amount in lines:
        known = amount is not None and amount == amount
        expected[store] = expected.get(store, 0) + (Decimal(repr(amount)) if known else 0)
    found = frame(LINES, lines)
    goods = frame(GOODS, [("p", "P", 1.0)])
    for days in (ops.daily_sales(found), ops.sales_day(found, goods)):
        assert {r["store_id"]: r["total_revenue"] for r in records(days, "store_id")} == {k: float(v) for k, v in expected.items()}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lines_of_a_hot_product_stay_spread(spark, how):
    """A third of the lines on one product, no broadcast of the products, no adaptive splitting."""
    from pyspark.sql import functions as F

    from shopmeter.operators.skew import heavy_keys, split_join

    lines = spark.range(300_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("p"), F.col("id") % 40_000)).alias("k"), "id"
    ).repartition(24)
    goods = spark.range(40_000).select(F.concat(F.lit("p"), "id").alias("k"), F.col("id").alias("cost"))
    goods = goods.filter("cost % 7 > 0").unionByName(spark.createDataFrame([("hot", 5)], "k string, cost long"))
    expected = sorted((r.id, r.cost) for r in lines.join(goods, "k", how).collect())
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "24"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        assert heavy_keys(lines, "k") == ["hot"]
        joined = split_join(lines, goods, "k", how)
        assert sorted((r.id, r.cost) for r in joined.collect()) == expected
        sizes = sorted(r["count"] for r in joined.filter("k is not null").groupBy(F.spark_partition_id()).count().collect())
        assert sizes[-1] <= 3 * sizes[len(sizes) // 2]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    few = spark.range(40).select(F.concat(F.lit("p"), "id").alias("k"))
    joins = [df._jdf.queryExecution().optimizedPlan().toString().count("Join ") for df in (split_join(lines, few, "k", how), joined)]
    assert joins == [1, 2]
