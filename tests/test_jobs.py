"""Reading, writing and the jobs end to end, on folders of their own."""

import contextlib
import datetime as dt
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from shopmeter import journal
from shopmeter.operators import lookups, metrics, quality
from shopmeter.plans import daily, extract, recent
from shopmeter.schemas import CLIENTS, PRODUCTS, RETAIL_DATA, SALES, STORES, TRAFFIC_METRICS
from shopmeter.sinks import merges, upsert, writers
from shopmeter.sources import catalog, incremental, tables
from shopmeter.streaming import arrival
from tests.conftest import records

FIRST = dt.date(2023, 11, 1)


def day(i):
    return (FIRST + dt.timedelta(days=i)).isoformat()


def traffic_rows(days, stores="ab"):
    return [
        (s, f"Store {s}", h, 40 + 7 * i + h, 4 + (i + h) % 5, day(i))
        for i in days for s in stores for h in (9, 13, 18)
    ]


def sales_rows(days, stores="ab"):
    return [
        (f"{s}{i}-{b}", 1, f"p{(i + b) % 3}", "c1", s, 1 + b, (i + 1) * 10.25 + b, "09:15:00", day(i))
        for i in days for s in stores for b in range(3)
    ]


@pytest.fixture
def write_feeds(spark, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("retail_data", "sales", "products", "metrics")}

    def write(days, stores="ab"):
        traffic = spark.createDataFrame(
            traffic_rows(days, stores), "store_id string, store_name string, hour int, visitors int, sales int, date string"
        )
        lines = spark.createDataFrame(
            sales_rows(days, stores), "sale_id string, nb_type_product int, product_id string, "
            "client_id string, store_id string, quantity int, sale_amount double, sale_time string, sale_date string"
        )
        goods = spark.createDataFrame(
            [(f"p{i}", f"Product {i}", "x", 2.0 + i, 1.0 + i) for i in range(3)],
            "id string, name string, category string, price double, cost double",
        )
        writers.write_partitions(traffic, paths["retail_data"], "date")
        writers.write_partitions(lines, paths["sales"], "sale_date")
        writers.write_snapshot(goods, paths["products"])

    return paths, write


def run(spark, paths):
    return daily.run_daily_metrics(
        spark, paths["retail_data"], paths["sales"], paths["products"], paths["metrics"]
    )


def stored(spark, paths):
    return records(tables.read_table(spark, paths["metrics"], TRAFFIC_METRICS), "date", "store_id")


def test_daily_job_is_idempotent(spark, write_feeds):
    paths, write = write_feeds
    write(range(10))
    assert run(spark, paths)
    before = stored(spark, paths)
    assert len(before) == 20
    assert not run(spark, paths)
    assert stored(spark, paths) == before


def test_day_by_day_equals_one_batch(spark, write_feeds, tmp_path):
    paths, write = write_feeds
    write(range(3))
    for upto in (3, 9, 30):
        write(range(upto))
        assert run(spark, paths)
    whole = dict(paths, metrics=str(tmp_path / "whole"))
    assert run(spark, whole)
    assert stored(spark, paths) == stored(spark, whole)


def test_daily_job_without_one_input_writes_nothing(spark, write_feeds, tmp_path):
    paths, write = write_feeds
    write(range(2))
    for missing in ("retail_data", "sales", "products"):
        lacking = dict(paths, **{missing: str(tmp_path / "nowhere")})
        assert not run(spark, lacking)
    assert not os.path.exists(paths["metrics"])


def test_daily_job_raises_on_a_broken_table(spark, write_feeds):
    paths, write = write_feeds
    write(range(2))
    os.makedirs(paths["metrics"])
    with open(paths["metrics"] + "/part.parquet", "w") as file:
        file.write("not parquet")
    with pytest.raises(Exception):
        run(spark, paths)


def metric_rows(spark, rows):
    found = spark.createDataFrame(rows, "date string, store_id string, total_visitors double")
    return tables.conform(found, TRAFFIC_METRICS)


def test_upsert_new_wins_and_other_stores_stay(spark, tmp_path):
    path = str(tmp_path / "metrics")
    upsert.upsert_metrics(metric_rows(spark, [
        ("2023-11-01", "store_1", 250.0), ("2023-12-01", "store_1", 1.0), ("2023-12-01", "store_2", 2.0),
    ]), path)
    new = metric_rows(spark, [("2023-12-01", "store_1", 300.0), ("2023-12-05", "store_9", 9.0)])
    for _ in range(2):
        upsert.upsert_metrics(new, path)
        found = records(tables.read_table(spark, path, TRAFFIC_METRICS), "date", "store_id")
        assert [(r["date"], r["store_id"], r["total_visitors"]) for r in found] == [
            ("2023-11-01", "store_1", 250.0), ("2023-12-01", "store_1", 300.0),
            ("2023-12-01", "store_2", 2.0), ("2023-12-05", "store_9", 9.0),
        ]
    upsert.upsert_metrics(new.limit(0), path)
    assert tables.read_table(spark, path, TRAFFIC_METRICS).count() == 4


def test_processed_dates_and_history(spark, tmp_path):
    metrics = metric_rows(spark, [
        ("2023-11-02", "s", 1.0), ("2023-11-03", "s", 1.0), ("2023-11-15", "s", 1.0), ("2023-12-01", "s", 1.0),
        ("2023-12-01", "t", 1.0),
    ])
    assert [d.isoformat() for d in incremental.processed_days(metrics)] == [
        "2023-11-02", "2023-11-03", "2023-11-15", "2023-12-01",
    ]
    missing = tables.read_table(spark, str(tmp_path / "none"), TRAFFIC_METRICS)
    assert incremental.processed_days(missing) == []
    history = incremental.history_before(metrics, dt.date(2023, 12, 1))
    assert [r["date"] for r in records(history, "date")] == ["2023-11-03", "2023-11-15"]


def test_processed_dates_are_anti_joined(spark, write_feeds):
    paths, write = write_feeds
    write(range(4))
    feed = tables.read_table(spark, paths["retail_data"], RETAIL_DATA)
    done = incremental.processed_dates(feed.filter(F.col("date") < F.lit(dt.date(2023, 11, 4))))
    left = incremental.not_processed(feed, "date", done)
    assert {r["date"] for r in records(left, "date")} == {"2023-11-04"}


def test_processed_partitions_are_not_read(spark, write_feeds):
    paths, write = write_feeds
    write(range(4))
    left = incremental.read_unprocessed(
        spark, paths["retail_data"], RETAIL_DATA, "date", [FIRST, FIRST + dt.timedelta(days=1)]
    )
    assert {r["date"] for r in records(left, "date")} == {"2023-11-03", "2023-11-04"}
    assert len(left.inputFiles()) == 2


def test_processed_folders_are_not_even_listed(spark, write_feeds):
    paths, write = write_feeds
    write(range(3))
    os.chmod(paths["retail_data"] + "/date=2023-11-01", 0)
    spoilt = paths["retail_data"] + "/date=2023-11-02/bad.parquet"
    with open(spoilt, "w") as file:
        file.write("not parquet")
    done = [FIRST, FIRST + dt.timedelta(days=1)]
    left = incremental.read_unprocessed(spark, paths["retail_data"], RETAIL_DATA, "date", done)
    os.chmod(paths["retail_data"] + "/date=2023-11-01", 0o755)
    assert {r["date"] for r in records(left, "date")} == {"2023-11-03"}
    assert incremental.new_days(spark, paths["retail_data"], "date", done) == [FIRST + dt.timedelta(days=2)]


def test_a_file_that_cannot_be_read_keeps_its_date_unpublished(spark, write_feeds):
    paths, write = write_feeds
    write(range(2))
    bad = paths["sales"] + "/sale_date=2023-11-01/bad.parquet"
    with open(bad, "w") as file:
        file.write("not parquet")
    with pytest.raises(Exception):
        incremental.read_unprocessed(spark, paths["sales"], SALES, "sale_date", []).count()
    with pytest.raises(Exception):
        run(spark, paths)
    assert not os.path.exists(paths["metrics"])
    assert [r["file"].rpartition("/")[2] for r in records(tables.unreadable_files(spark, paths["sales"]), "file")] == ["bad.parquet"]
    os.remove(bad)
    assert run(spark, paths)


def test_partition_value_wins_over_the_column_in_the_file(spark, tmp_path):
    folder = tmp_path / "date=2023-12-01"
    folder.mkdir()
    pd.DataFrame({"store_id": ["s"], "hour": [1], "date": ["1999-01-01"]}).to_parquet(
        folder / "retail_data_2023-12-01.parquet"
    )
    for found in (
        tables.read_table(spark, str(tmp_path), RETAIL_DATA),
        incremental.read_unprocessed(spark, str(tmp_path), RETAIL_DATA, "date", []),
    ):
        assert found.first()["date"] == dt.date(2023, 12, 1)
    done = [dt.date(2023, 12, 1)]
    assert incremental.read_unprocessed(spark, str(tmp_path), RETAIL_DATA, "date", done).isEmpty()


def test_many_stores_in_parallel_files(spark, tmp_path):
    """A large date is split over files, a small one stays whole; rows come back complete."""
    rows = spark.range(2000).selectExpr(
        "cast(id % 50 as string) store_id", "'n' store_name", "cast(id % 24 as int) hour",
        "cast(id as int) visitors", "1 sales",
        "date_add(date'2024-01-01', cast(if(id % 3 = 0, 0, id % 7) as int)) date",
    )
    path = str(tmp_path / "t")
    writers.write_partitions(rows, path, "date")
    back = tables.read_table(spark, path, RETAIL_DATA)
    assert back.count() == 2000 and back.agg(F.sum("visitors")).first()[0] == 2000 * 1999 // 2


def write_day(tmp_path, day, values, name="retail_data"):
    folder = tmp_path / f"date={day}"
    folder.mkdir(exist_ok=True)
    pd.DataFrame({
        "store_id": ["s"] * len(values), "hour": range(len(values)), "visitors": values, "date": day,
    }).to_parquet(folder / f"{name}_{day}.parquet")


def test_days_of_other_types_are_read_together(spark, tmp_path):
    """Counts are floats on a day with gaps when the writer infers types."""
    write_day(tmp_path, "2023-12-01", [5, 6])
    write_day(tmp_path, "2023-12-02", [7, None])
    write_day(tmp_path, "2023-12-03", [8, 9])
    found = incremental.read_unprocessed(spark, str(tmp_path), RETAIL_DATA, "date", [dt.date(2023, 12, 3)])
    assert found.schema == RETAIL_DATA
    whole = tables.read_table(spark, str(tmp_path), RETAIL_DATA).filter(F.col("date") < F.lit(dt.date(2023, 12, 3)))
    for frame_ in (found, whole):
        assert [(r["date"], r["visitors"]) for r in records(frame_, "date", "hour")] == [
            ("2023-12-01", 5), ("2023-12-01", 6), ("2023-12-02", 7), ("2023-12-02", None),
        ]


def test_files_of_other_columns_are_read_complete(spark, tmp_path):
    """One file of a day has sales, the other has not; a later day has them as floats."""
    write_day(tmp_path, "2023-12-01", [5, 6], "a")
    folder = tmp_path / "date=2023-12-01"
    pd.DataFrame({"store_id": ["t"], "hour": [9], "sales": [7], "date": ["2023-12-01"]}).to_parquet(folder / "b.parquet")
    (tmp_path / "date=2023-12-02").mkdir()
    pd.DataFrame({"store_id": ["t"], "hour": [9], "sales": [3.0], "date": ["2023-12-02"]}).to_parquet(
        tmp_path / "date=2023-12-02" / "c.parquet")
    for found in (
        tables.read_table(spark, str(tmp_path), RETAIL_DATA),
        incremental.read_unprocessed(spark, str(tmp_path), RETAIL_DATA, "date", []),
    ):
        assert [(r["date"], r["store_id"], r["visitors"], r["sales"]) for r in records(found, "date", "store_id", "hour")] == [
            ("2023-12-01", "s", 5, None), ("2023-12-01", "s", 6, None), ("2023-12-01", "t", None, 7), ("2023-12-02", "t", None, 3),
        ]
    new = tables.read_days(spark, str(tmp_path), RETAIL_DATA, "date", [dt.date(2023, 12, 2)])
    merges.write_merged_day(spark, new.withColumn("date", F.lit(dt.date(2023, 12, 1))), str(tmp_path), RETAIL_DATA, "date", dt.date(2023, 12, 1))
    merged = tables.read_days(spark, str(tmp_path), RETAIL_DATA, "date", [dt.date(2023, 12, 1)])
    assert sorted(r["sales"] for r in merged.collect() if r["sales"] is not None) == [3, 7]
    assert merged.filter("visitors is not null").count() == 2


def test_a_stored_day_loses_nothing(spark, tmp_path):
    """Unknown columns and values that the schema can't hold stop the merge."""
    day_ = dt.date(2023, 12, 1)
    new = spark.createDataFrame([("s", "n", 1, 1, 1, day_)], "store_id string, store_name string, hour int, visitors int, sales int, date date")
    for name, extra in (("a", {"staff": [4]}), ("b", {"visitors": [2.5]})):
        folder = tmp_path / name / "date=2023-12-01"
        folder.mkdir(parents=True)
        pd.DataFrame({"store_id": ["s"], "hour": [9], "sales": [7], **extra}).to_parquet(folder / "x.parquet")
        before = sorted(os.listdir(folder))
        with pytest.raises(Exception, match="staff|can't hold"):
            merges.write_merged_day(spark, new, str(tmp_path / name), RETAIL_DATA, "date", day_)
        assert sorted(os.listdir(folder)) == before
        assert not [x for x in os.listdir(tmp_path) if "staged" in x]


def test_a_write_that_fails_half_way_leaves_the_old_day(spark, write_feeds):
    paths, write = write_feeds
    write(range(2))
    stored_ = tables.read_table(spark, paths["retail_data"], RETAIL_DATA)
    before = records(stored_, "date", "store_id", "hour")
    failing = stored_.withColumn("visitors", F.when(F.col("hour") == 18, F.raise_error("half way").cast("int")).otherwise(1))
    with pytest.raises(Exception, match="half way"):
        writers.replace_days(failing, paths["retail_data"], "date", [FIRST, FIRST + dt.timedelta(days=1)])
    assert records(tables.read_table(spark, paths["retail_data"], RETAIL_DATA), "date", "store_id", "hour") == before
    with pytest.raises(ValueError, match="other days"):
        writers.replace_days(stored_, paths["retail_data"], "date", [FIRST])


def test_a_missing_dataset_can_be_an_error(spark, tmp_path, write_feeds):
    paths, write = write_feeds
    write([0])
    assert tables.read_dataset(spark, paths["products"], PRODUCTS).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_dataset(spark, str(tmp_path / "none"), PRODUCTS)


def test_missing_days_and_unpartitioned_folders(spark, tmp_path):
    write_day(tmp_path / "", "2023-12-01", [5])
    some = tables.read_days(
        spark, str(tmp_path), RETAIL_DATA, "date", [dt.date(2023, 12, 1), dt.date(2023, 12, 9)]
    )
    assert [r["date"] for r in records(some, "date")] == ["2023-12-01"]
    assert tables.read_days(spark, str(tmp_path), RETAIL_DATA, "date", []).isEmpty()
    (tmp_path / "hollow").mkdir()
    hollow = incremental.read_unprocessed(spark, str(tmp_path / "hollow"), RETAIL_DATA, "date", [])
    assert hollow.isEmpty() and hollow.schema == RETAIL_DATA
    flat = str(tmp_path / "date=2023-12-01" / "retail_data_2023-12-01.parquet")
    with pytest.raises(ValueError):
        incremental.read_unprocessed(spark, flat, RETAIL_DATA, "day", [])


def test_other_types_within_a_day_are_read_together(spark, tmp_path):
    write_day(tmp_path, "2023-12-01", [5, 6], "a")
    write_day(tmp_path, "2023-12-01", [7, None], "b")
    found = incremental.read_unprocessed(spark, str(tmp_path), RETAIL_DATA, "date", [])
    assert sorted(str(r["visitors"]) for r in found.collect()) == ["5", "6", "7", "None"]


def test_a_stored_day_of_other_types_can_be_merged(spark, tmp_path):
    (tmp_path / "t" / "date=2023-12-01").mkdir(parents=True)
    pd.DataFrame({"store_id": ["1"], "store_name": ["S"], "hour": [9], "visitors": [float("nan")],
                  "sales": [4.0], "date": ["2023-12-01"]}).to_parquet(
        tmp_path / "t" / "date=2023-12-01" / "retail_data_2023-12-01.parquet")
    row = {"store_id": "1", "store_name": "S", "date": "2023-12-01", "hour": 10, "visitors": 5, "sales": 3}
    feed = dump(tmp_path / "t.json", [row, dict(row, hour=9, visitors=None, sales=4)])
    extract.extract_traffic(spark, feed, str(tmp_path / "t"), "2023-12-01")
    found = records(tables.read_table(spark, str(tmp_path / "t"), RETAIL_DATA), "hour")
    assert [(r["hour"], r["visitors"], r["sales"]) for r in found] == [(10, 5, 3), (9, None, 4)]


def test_lookup_by_date_and_store_reaches_the_scan(spark, write_feeds):
    paths, write = write_feeds
    write(range(3))
    sales = tables.read_table(spark, paths["sales"], SALES)
    found = lookups.sales_by_date_store(sales, "2023-11-02", "a")
    assert found.count() == 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sale_date" in plan
    assert "EqualTo(store_id,a)" in plan


def test_full_history_reaches_beyond_four_weeks(spark, write_feeds, tmp_path):
    paths, write = write_feeds
    write([0])
    assert run(spark, paths)
    write([42])
    other = dict(paths, metrics=str(tmp_path / "full"))
    spark.read.parquet(paths["metrics"]).write.partitionBy("date").parquet(other["metrics"])
    assert run(spark, paths)
    daily.run_daily_metrics(
        spark, other["retail_data"], other["sales"], other["products"], other["metrics"],
        full_history=True,
    )
    short, long = stored(spark, paths)[-1], stored(spark, other)[-1]
    assert short["avg_visitors_last_4_weeks"] == short["total_visitors"]
    assert long["avg_visitors_last_4_weeks"] < long["total_visitors"]


def test_a_following_batch_reads_the_kept_rows_only(spark, write_feeds):
    paths, write = write_feeds
    path = paths["metrics"]
    for upto in (8, 10):
        write(range(upto))
        assert run(spark, paths)
        done = tables.day_folders(spark, path, "date")
        start = done[-1] + dt.timedelta(days=1)
        last = recent.following(spark, path, done, start)
        assert last.since is None
        for full in (False, True):
            kept = recent.history(spark, path, done, start, last, full)
            read = recent.history(spark, path, done, start, None, full)
            assert all("/_recent-metrics/" in file for file in kept.inputFiles())
            assert not any("/_recent-metrics/" in file for file in read.inputFiles())
            assert records(kept, "date", "store_id") == records(metrics.last_rows(read), "date", "store_id")
    # Averages with and without them are the same, also where days are missing.
    whole = dict(paths, metrics=path + "_whole")
    write([15, 22, 29, 36])
    assert run(spark, paths) and run(spark, whole)
    assert stored(spark, paths) == stored(spark, whole)


def test_kept_rows_of_another_state_of_the_table_are_not_used(spark, write_feeds, monkeypatch):
    paths, write = write_feeds
    path = paths["metrics"]

    def usable(full=False):
        done = tables.day_folders(spark, path, "date")
        return recent.following(spark, path, done, done[-1] + dt.timedelta(days=1), full)

    write([0, 1, *range(40, 44)])
    assert run(spark, paths)
    assert usable() and usable(full=True)
    # A batch of earlier dates is averaged over the table, then the last four weeks are kept.
    write([2])
    done = tables.day_folders(spark, path, "date")
    assert recent.following(spark, path, done, done[1] + dt.timedelta(days=1)) is None
    assert run(spark, paths)
    assert usable().since == dt.date.fromisoformat(stored(spark, paths)[-1]["date"]) - dt.timedelta(days=27)
    assert usable(full=True) is None
    # Another writer's commit, and a job killed before it kept its rows.
    rows = tables.read_table(spark, path, TRAFFIC_METRICS)
    upsert.upsert_metrics(rows.filter(F.col("date") == done[-1]), path)
    assert usable() is None
    write([44])
    monkeypatch.setattr(recent, "keep", lambda *a: None)
    assert run(spark, paths)
    assert usable() is None
    monkeypatch.undo()
    write([45])
    assert run(spark, paths)
    assert usable()
    # Days taken away from outside.
    removed = f"{path}/date={tables.day_folders(spark, path, 'date')[3].isoformat()}"
    journal._delete(spark, removed)
    assert usable() is None


def test_last_rows_of_stores_and_weekdays(frame):
    measures = "total_transactions long, total_visitors double, total_revenue double"
    days = [(f"2024-01-{day:02d}", "a", day, 1.0, 2.0) for day in range(1, 31, 7)]
    others = [("2024-01-02", "a", 0, None, None), (None, "a", 1, 1.0, 1.0), ("2024-01-01", None, 1, 1.0, 1.0),
              ("2024-01-01", "b", None, 1.0, 1.0)]
    rows = frame(f"date string, store_id string, {measures}", days + others)
    found = records(metrics.last_rows(rows), "store_id", "date")
    assert [(r["store_id"], r["date"]) for r in found] == [
        ("a", "2024-01-02"), ("a", "2024-01-15"), ("a", "2024-01-22"), ("a", "2024-01-29"), ("b", "2024-01-01"),
    ]
    assert metrics.last_rows(rows.limit(0)).count() == 0


def test_flat_files_are_chosen_by_name(spark, tmp_path):
    for name in ("a_2023-12-01.parquet", "a_2023-12-02.parquet", "undated.parquet"):
        pd.DataFrame({"store_id": ["s"], "hour": [1], "date": [name[2:12]]}).to_parquet(tmp_path / name)
    (tmp_path / "a_2023-12-03.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        incremental.read_unprocessed_files(spark, str(tmp_path), RETAIL_DATA, [dt.date(2023, 12, 1)]).collect()
    found = incremental.read_unprocessed_files(
        spark, str(tmp_path), RETAIL_DATA, [dt.date(2023, 12, 1), dt.date(2023, 12, 3)]
    )
    assert [r["date"] for r in records(found, "date")] == ["2023-12-02"]
    nothing = incremental.read_unprocessed_files(spark, str(tmp_path / "none"), RETAIL_DATA, [])
    assert nothing.isEmpty()


def test_date_of_file(frame):
    names = frame("name string", [("sales_2023-12-01.parquet",), ("sales.parquet",), ("x_2023-13-01.parquet",)])
    found = names.select("name", incremental.date_of_file(names.name).alias("date"))
    assert [r["date"] for r in records(found, "name")] == [None, "2023-12-01", None]


def test_merge_drops_full_repeats_only(frame):
    old = frame("k string, v int", [("a", 1), ("b", None)])
    new = frame("k string, v int, extra string", [("a", 1, None), ("b", None, None), ("a", 2, None)])
    assert merges.merge_days(old, new).count() == 3


def dump(path, rows):
    """A feed as JSON lines."""
    path.write_text("".join(json.dumps(row) + "\n" for row in rows), encoding="utf-8")
    return str(path)


def sale(sale_id, date, store="s1", amount=5.0):
    return {
        "sale_id": sale_id, "nb_type_product": 1, "product_id": "p", "client_id": "c",
        "store_id": store, "quantity": 1, "sale_amount": amount, "sale_date": date,
        "sale_time": "10:00:00",
    }


def test_sales_extraction_merges_days(spark, tmp_path):
    target = str(tmp_path / "sales")
    feed = dump(tmp_path / "f1.json", [
        sale("1", "2023-12-01"), sale("2", "2023-12-01", "s2"), sale("9", "2023-12-02"),
        {"error": "No sales found for store ID: 3"},
    ])
    assert extract.extract_sales(spark, feed, target, "2023-12-01")
    assert not extract.extract_sales(spark, feed, target, "2024-01-01")
    more = dump(tmp_path / "f2.json", [sale("2", "2023-12-01", "s2"), sale("3", "2023-12-01")])
    assert extract.extract_sales(spark, more, target, "2023-12-01")
    assert extract.extract_sales(spark, feed, target, "2023-12-02")
    found = records(tables.read_table(spark, target, SALES), "sale_date", "sale_id")
    assert [(r["sale_date"], r["sale_id"]) for r in found] == [
        ("2023-12-01", "1"), ("2023-12-01", "2"), ("2023-12-01", "3"), ("2023-12-02", "9"),
    ]
    with pytest.raises(ValueError):
        extract.extract_sales(spark, feed, target, "01/12/2023")


def test_traffic_extraction(spark, tmp_path):
    row = {"store_id": "1", "store_name": "S", "date": "2023-12-01", "hour": 10, "visitors": None, "sales": 3}
    feed, target = dump(tmp_path / "t.json", [row, dict(row, hour=11, visitors=5)]), str(tmp_path / "t")
    for _ in range(2):
        extract.extract_traffic(spark, feed, target, "2023-12-01")
        found = records(tables.read_table(spark, target, RETAIL_DATA), "hour")
        assert [(r["hour"], r["visitors"]) for r in found] == [(10, None), (11, 5)]
    with pytest.raises(ValueError):
        extract.extract_traffic(spark, feed, target, "2023-12-02")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        extract.extract_traffic(spark, str(tmp_path / "missing.json"), target, "2023-12-01")


def test_snapshot_extraction(spark, tmp_path):
    clients = dump(tmp_path / "c.json", [
        {"id": "1", "name": "A", "age": 30, "gender": "Femme", "loyalty_card": True, "city": "Paris"}
    ])
    stores = dump(tmp_path / "s.json", [
        {"id": "1", "name": "S", "location": "Paris", "capacity": 100, "opening_hour": "9", "closing_hour": "18"}
    ])
    products = dump(tmp_path / "p.json", [
        {"id": "1", "name": "P", "category": "x", "price": 2.5, "cost": 1.5}
    ])
    for _ in range(2):
        extract.extract_clients(spark, clients, str(tmp_path / "clients"))
        extract.extract_stores(spark, stores, str(tmp_path / "stores"))
        extract.extract_products(spark, products, str(tmp_path / "products"))
    (client,) = records(tables.read_table(spark, str(tmp_path / "clients"), CLIENTS), "id")
    assert (client["age"], client["loyalty_card"]) == (30, True)
    (store,) = records(tables.read_table(spark, str(tmp_path / "stores"), STORES), "id")
    assert (store["opening_hour"], store["closing_hour"]) == ("9", "18")
    assert tables.read_table(spark, str(tmp_path / "products"), PRODUCTS).count() == 1
    broken = tmp_path / "broken.json"
    broken.write_text('[{"id": "2", "name": "B"}, {"id": "3", "na')
    jobs = {"clients": extract.extract_clients, "stores": extract.extract_stores, "products": extract.extract_products}
    for name, job in jobs.items():
        for feed in (str(tmp_path / "none.json"), str(broken), dump(tmp_path / "e.json", [])):
            for lines in (True, False):
                with pytest.raises(Exception):
                    job(spark, feed, str(tmp_path / name), lines=lines)
                assert spark.read.parquet(str(tmp_path / name)).count() == 1
    whole = tmp_path / "whole.json"
    whole.write_text(json.dumps([{"id": "7"}, {"id": "8"}]))
    assert tables.read_json_feed(spark, str(whole), CLIENTS, lines=False).count() == 2
    for lines in (True, False):
        with pytest.raises(Exception, match="PATH_NOT_FOUND|no JSON"):
            extract.extract_sales(spark, str(broken), str(tmp_path / "sales"), "2023-12-01", lines=lines)
        with pytest.raises(Exception, match="PATH_NOT_FOUND|no JSON"):
            extract.extract_sales(spark, str(tmp_path / "none.json"), str(tmp_path / "sales"), "2023-12-01", lines=lines)
    extract.extract_clients(spark, dump(tmp_path / "e.json", []), str(tmp_path / "clients"), allow_empty=True)
    assert spark.read.parquet(str(tmp_path / "clients")).count() == 0


@pytest.mark.parametrize("codec", ["zstd", "snappy"])
def test_parquet_round_trip(spark, tmp_path, codec):
    df = spark.createDataFrame([(1, 2), (3, 4)], "col1 int, col2 int")
    writers.write_snapshot(df, str(tmp_path / "t"), codec)
    writers.write_snapshot(df, str(tmp_path / "t"), codec)
    files = os.listdir(tmp_path / "t")
    assert any(codec in name for name in files)
    assert records(spark.read.parquet(str(tmp_path / "t")), "col1") == records(df, "col1")
    assert tables.cached_table(spark, str(tmp_path / "t"), df.schema).count() == 2


def test_conform_casts_fills_and_refuses(spark):
    found = spark.createDataFrame([("a", 9, 3.0)], "id string, opening_hour int, capacity double")
    (row,) = records(tables.conform(found, STORES), "id")
    assert (row["opening_hour"], row["closing_hour"], row["capacity"], row["name"]) == ("9", None, 3, None)
    nan = spark.createDataFrame([("s", float("nan"))], "store_id string, visitors double")
    assert records(tables.conform(nan, RETAIL_DATA), "store_id")[0]["visitors"] is None
    for value, kind in ((2.5, "double"), ("many", "string"), (2**40, "long")):
        with pytest.raises(Exception, match="capacity can't hold"):
            tables.conform(spark.createDataFrame([("a", value)], f"id string, capacity {kind}"), STORES).collect()


def test_numbers_of_a_feed_in_any_form(spark, tmp_path):
    rows = [sale("1", "2023-12-01") | {"quantity": 5.0}, sale("2", "2023-12-01") | {"quantity": "3", "sale_amount": "5.5"},
            sale("3", "2023-12-01") | {"quantity": 2.5}, sale("4", "2023-12-01") | {"sale_amount": "much"},
            sale("5", "1st of May"), sale("6", "2023-12-01") | {"quantity": None}]
    feed = tables.read_json_feed(spark, dump(tmp_path / "n.json", rows), SALES)
    found = {r["sale_id"]: (r["quantity"], r["sale_amount"], r["error"]) for r in records(feed, "sale_id")}
    assert found["1"] == (5, 5.0, None) and found["2"] == (3, 5.5, None) and found["6"] == (None, 5.0, None)
    assert [found[k][2] for k in "345"] == ["unfit quantity", "unfit sale_amount", "unfit sale_date"]
    counts = quality.feed_quality(feed, ["sale_id"]).first()
    assert (counts["rows"], counts["error_rows"], counts["usable_rows"]) == (6, 3, 3)


def test_files_differing_in_columns_are_united(spark, tmp_path):
    path = str(tmp_path / "goods")
    spark.createDataFrame([("1", "A")], "id string, name string").write.parquet(path)
    spark.createDataFrame([("2", 3.5)], "id string, price double").write.mode("append").parquet(path)
    rows = records(tables.read_table(spark, path, PRODUCTS), "id")
    assert [(r["name"], r["price"]) for r in rows] == [("A", None), (None, 3.5)]


def test_json_lines_missing_file_and_error_rows(spark, tmp_path):
    path = tmp_path / "sales.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in [
        sale("1", "2023-12-01"), {"error": "none"}, sale(None, "2023-12-01"),
    ]))
    feed = tables.read_json_feed(spark, str(path), SALES, lines=True)
    assert tables.error_rows(feed, ["sale_id"]).count() == 2
    assert tables.drop_error_rows(feed, ["sale_id"]).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_json_feed(spark, str(tmp_path / "none.json"), SALES)


def test_file_inventory(spark, write_feeds):
    paths, write = write_feeds
    write(range(3))
    pd.DataFrame({"sale_id": pd.Series([], dtype="str")}).to_parquet(paths["sales"] + "/none.parquet")
    with open(paths["sales"] + "/bad.parquet", "w") as file:
        file.write("not parquet")
    counts = records(tables.file_inventory(spark, paths["sales"]), "file")
    assert sum(r["records"] or 0 for r in counts) == 18 and len(counts) == 5
    special = {r["file"].rpartition("/")[2]: (r["records"], r["readable"]) for r in counts if "=" not in r["file"]}
    assert special == {"none.parquet": (0, True), "bad.parquet": (None, False)}


def test_extract_inventory(spark, write_feeds, tmp_path):
    paths, write = write_feeds
    write(range(2))
    pd.DataFrame({"id": ["1", "2"]}).to_parquet(tmp_path / "stores.parquet")
    (tmp_path / "sales" / "sale_date=2023-11-01" / "bad.parquet").write_text("not parquet")
    (tmp_path / "notes.txt").write_text("ignored")
    rows = records(tables.extract_inventory(spark, str(tmp_path)), "dataset")
    assert [r["dataset"] for r in rows if r["unreadable_files"]] == ["sales/sale_date=2023-11-01"]
    assert [(r["dataset"], r["records"]) for r in rows] == [
        ("products", 3), ("retail_data/date=2023-11-01", 6), ("retail_data/date=2023-11-02", 6),
        ("sales/sale_date=2023-11-01", 6), ("sales/sale_date=2023-11-02", 6), ("stores.parquet", 2),
    ]


def test_catalog_tables_and_new_partitions(spark, write_feeds):
    paths, write = write_feeds
    write(range(2))
    names = catalog.create_external_tables(
        spark, {n: paths[n] for n in ("sales", "retail_data", "products")}, "shop"
    )
    assert names == ["shop.sales", "shop.retail_data", "shop.products"]
    assert spark.table("shop.products").count() == 3
    for name in names[:2]:
        catalog.refresh_partitions(spark, name)
    assert spark.table("shop.sales").count() == 12
    write(range(2, 4))
    assert spark.table("shop.sales").count() == 12
    catalog.refresh_partitions(spark, "shop.sales")
    assert spark.table("shop.sales").count() == 24
    assert dict(spark.table("shop.sales").dtypes)["sale_date"] == "date"


def test_csv_export(spark, tmp_path):
    assert writers.export_name("Annuel") == "metrics_all_stores_Annuel.csv"
    assert writers.export_name("Quotidien", "7", 2023, 12) == "metrics_store_7_Quotidien_2023_12.csv"
    assert writers.export_name("Mensuel", None, 2023) == "metrics_all_stores_Mensuel_2023.csv"
    folder = str(tmp_path / writers.export_name("Annuel"))
    writers.export_csv(spark.createDataFrame([(1, "é")], "a int, b string"), folder)
    assert [tuple(r) for r in spark.read.csv(folder, header=True).collect()] == [("1", "é")]


def test_files_on_arrival(spark, write_feeds, tmp_path):
    paths, write = write_feeds
    checkpoint = str(tmp_path / "stream")

    def follow():
        query = arrival.run_on_arrival(
            spark, paths["retail_data"], paths["sales"], paths["products"], paths["metrics"], checkpoint
        )
        query.awaitTermination(120)
        assert query.exception() is None
        return query

    write(range(3))
    follow()
    assert len(stored(spark, paths)) == 6
    assert follow().lastProgress is None or follow().lastProgress["numInputRows"] == 0
    write(range(3, 5))
    follow()
    assert len(stored(spark, paths)) == 10


def test_a_date_waits_for_its_second_feed(spark, write_feeds, tmp_path):
    paths, write = write_feeds
    write(range(2))
    late = paths["sales"] + "/sale_date=2023-11-02"
    os.rename(late, str(tmp_path / "late"))

    def follow():
        query = arrival.run_on_arrival(
            spark, paths["retail_data"], paths["sales"], paths["products"], paths["metrics"], str(tmp_path / "stream")
        )
        with contextlib.suppress(Exception):
            query.awaitTermination(120)
        return query.exception()

    for _ in range(2):
        assert "2023-11-02" in str(follow())
        assert {r["date"] for r in stored(spark, paths)} == {"2023-11-01"}
    os.rename(str(tmp_path / "late"), late)
    assert follow() is None
    assert {r["date"] for r in stored(spark, paths)} == {"2023-11-01", "2023-11-02"}
