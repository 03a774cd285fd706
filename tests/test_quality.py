from shopmeter.operators import quality as ops
from tests.conftest import records

HOURS = "date string, store_id string, hour int, visitors int, sales int"
STORES = "id string, location string, capacity int, opening_hour string, closing_hour string"
LINES = (
    "sale_id string, product_id string, client_id string, store_id string, nb_type_product int, "
    "quantity int, sale_amount double"
)


def test_feeds_reconcile(frame):
    sales = frame("sale_id string, store_id string", [("1", "1"), ("2", "1"), ("2", "1"), ("3", "2")])
    traffic = frame("store_id string, sales int, hour int", [("1", 2, 10), ("1", 5, 18), ("1", 5, 8), ("3", 1, 10)])
    stores = frame(STORES, [("1", "x", 1, "9", "18"), ("2", "x", 1, "9", "18"), ("3", "x", 1, "?", "18")])
    rows = records(ops.reconcile_sales_traffic(sales, traffic, stores), "store_id")
    assert rows == [
        {"store_id": "1", "basket_sales": 2, "traffic_sales": 2, "matches": True},
        {"store_id": "2", "basket_sales": 1, "traffic_sales": None, "matches": False},
    ]
    wrong = ops.reconcile_sales_traffic(sales, traffic, stores, only_mismatches=True)
    assert [r["store_id"] for r in records(wrong, "store_id")] == ["2"]


def test_closed_hours_and_capacity(frame):
    stores = frame(STORES, [("1", "x", 100, "10", "18")])
    traffic = frame(HOURS, [
        ("2023-12-01", "1", 9, 5, 0), ("2023-12-01", "1", 8, 0, 0), ("2023-12-01", "1", 10, 100, 1),
        ("2023-12-01", "1", 18, 0, 2), ("2023-12-01", "1", 11, 101, 1),
        ("2023-12-02", "1", 11, 125, 1), ("2023-12-02", "1", 12, 126, 1), ("2023-12-02", "1", 13, None, 1),
    ])
    assert [r["hour"] for r in records(ops.closed_hours(traffic, stores), "hour")] == [18, 9]
    over = records(ops.over_capacity(traffic, stores), "date")
    assert [(r["date"], r["hour"], r["visitor_limit"]) for r in over] == [
        ("2023-12-01", 11, 100), ("2023-12-02", 12, 125),
    ]


def test_traffic_profile(frame):
    rows = [("2023-12-01", "1", 1, None, None), ("2023-12-01", "1", 2, 6000, 1),
            ("2023-12-01", "1", 3, None, 1), ("2023-12-01", "1", 4, 5000, 1)]
    (row,) = records(ops.traffic_profile(frame(HOURS, rows)), "store_id")
    assert (row["hours"], row["null_hours"], row["outlier_hours"]) == (4, 1, 1)
    assert (row["null_rate"], row["outlier_rate"]) == (0.25, 0.25)


def test_line_basket_and_client_checks(frame):
    sales = frame(LINES, [
        ("1", "p", "c1", "s1", 2, 3, 29.97), ("1", "q", "c1", "s1", 2, 1, 5.0),
        ("2", "p", "c2", "s1", 2, 2, 20.0), ("3", "zz", "c9", "s1", 1, 1, 1.0),
    ])
    goods = frame("id string, price double", [("p", 9.99), ("q", 5.0)])
    wrong = records(ops.line_amount_errors(sales, goods), "sale_id")
    assert [(r["sale_id"], r["expected_amount"], r["reason"]) for r in wrong] == [
        ("2", 19.98, "other amount"), ("3", None, "unknown product"),
    ]
    baskets = records(ops.basket_size_errors(sales), "sale_id")
    assert baskets == [{"sale_id": "2", "declared": 2, "found": 1}]
    clients = frame("id string, city string, age int", [("c1", "Paris", 30), ("c2", "Lyon", 250)])
    stores = frame(STORES, [("s1", "Paris", 1, "9", "18")])
    pairs = records(ops.client_city_errors(sales, clients, stores), "client_id")
    assert [(r["client_id"], r["city"], r["location"], r["lines"], r["reason"]) for r in pairs] == [
        ("c2", "Lyon", "Paris", 1, "other city"), ("c9", None, "Paris", 1, "unknown client"),
    ]
    assert [r["id"] for r in records(ops.unrealistic_ages(clients), "id")] == ["c2"]


def test_feed_quality(frame):
    feed = frame("sale_id string, store_id string, error string", [
        ("1", "1", None), (None, "1", None), (None, None, "no sales"), ("2", "1", None),
    ])
    (row,) = records(ops.feed_quality(feed, ["sale_id", "store_id"]), "rows")
    assert row == {"rows": 4, "error_rows": 1, "keyless_rows": 2, "usable_rows": 2}


def test_missing_values_do_not_pass_a_check(frame):
    sales = frame(LINES, [
        ("1", "p", "c1", "s1", 1, 1, None), ("1", "p", "c1", "s1", 2, 1, 9.99), ("2", "p", "c2", "s1", None, 1, 9.99),
    ])
    goods = frame("id string, price double", [("p", 9.99)])
    assert [r["sale_id"] for r in records(ops.line_amount_errors(sales, goods), "sale_id")] == ["1"]
    assert [r["sale_id"] for r in records(ops.basket_size_errors(sales), "sale_id")] == ["1", "2"]
    clients = frame("id string, city string", [("c1", "Paris"), ("c2", None)])
    stores = frame(STORES, [("s1", "Paris", 1, "9", "18")])
    assert [r["client_id"] for r in records(ops.client_city_errors(sales, clients, stores), "client_id")] == ["c2"]


def test_what_cannot_be_judged_is_reported_with_a_reason(frame):
    stores = frame(STORES, [("1", "x", None, "10", "18"), ("2", "x", 50, "late", "18"), ("3", "x", 50, "10", "18")])
    traffic = frame(HOURS, [
        ("2023-12-01", "9", 11, 5, 0), ("2023-12-01", "1", 11, 5, 0), ("2023-12-01", "2", 11, 5, 0),
        ("2023-12-01", "3", 11, 5, 0), ("2023-12-01", "3", 9, 51, None), ("2023-12-01", "3", None, 1, 1),
        (None, "3", 12, 1, 1), ("2023-12-01", None, 12, 1, 1), ("2023-12-01", "9", 11, None, None),
    ])
    closed = ops.closed_hours(traffic, stores)
    assert sorted((r["store_id"] or "", r["hour"] or 0, r["reason"]) for r in closed.collect()) == [
        ("", 12, "unknown store"), ("2", 11, "unreadable hours"), ("3", 0, "unreadable hours"), ("3", 9, "closed"),
        ("9", 11, "unknown store"),
    ]
    over = ops.over_capacity(traffic, stores)
    assert sorted((r["store_id"] or "", r["hour"] or 0, r["reason"]) for r in over.collect()) == [
        ("", 12, "unknown store"), ("1", 11, "missing capacity"), ("3", 9, "over capacity"), ("3", 12, "missing date"),
        ("9", 11, "unknown store"),
    ]
