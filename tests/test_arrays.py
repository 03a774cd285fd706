"""JSON arrays cut between tasks give the rows and errors of a reader of whole files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from shopmeter.schemas import CLIENTS
from shopmeter.sources import tables
from shopmeter.sources.arrays import array_elements

NASTY = ["", "}", "{", "]", "[", '"', "\\", "\\\\", '\\"', "},{", "}]", "[{", "é日本😀", "\n\t", "a,b", ' "}" ', "\\u007d", "plain words"]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def objects(seed, n):
    draw = random.Random(seed)
    text = lambda: "".join(draw.choice(NASTY) for _ in range(draw.randrange(4)))
    out = []
    for i in range(n):
        one = {"id": str(i), "name": text(), text() or "k": text()}
        if draw.random() < 0.3:
            one["nested"] = {"a": [{"b": text()}, [], {}], "c": {"d": text()}}
        if draw.random() < 0.05:
            one["city"] = text() + "long } { \\ " * draw.randrange(200)
        out.append(one)
    return out


def whole(spark, path, monkeypatch=None):
    """What Spark's reader of whole files gives."""
    found = spark.read.schema("id string, name string, city string").option("multiLine", "true").json(path)
    return sorted(tuple(r) for r in found.collect())


def split(spark, path):
    feed = tables.read_json_feed(spark, path, CLIENTS, lines=False)
    return sorted(tuple(r) for r in feed.select("id", "name", "city").collect())


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("ascii_only", [True, False])
def test_arrays_equal_the_reader_of_whole_files(spark, tmp_path, small_splits, indent, ascii_only):
    folder = tmp_path / "feed"
    folder.mkdir()
    for seed in range(3):
        rows = objects(seed, 60 * seed + 1)
        (folder / f"{seed}.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    (folder / "none.json").write_text(" [\n ] ")
    (folder / "one.json").write_text('{"id": "alone", "name": "}{"}')
    (folder / "empty.json").write_text("")
    expected = whole(spark, str(folder))
    assert split(spark, str(folder)) == expected and len(expected) == 184
    elements, others = array_elements(spark, str(folder))
    assert [name.rpartition("/")[2] for name in others] == ["one.json"]
    assert elements.rdd.getNumPartitions() > 20


def test_one_large_array_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "large.json"
    path.write_text(json.dumps([{"id": str(i), "name": "x" * 50, "age": i % 90} for i in range(120_000)]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400000")
    try:
        feed = tables.read_json_feed(spark, str(path), CLIENTS, lines=False)
        parts = feed.groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) > 15 and max(r["count"] for r in parts) < 12_000
        assert feed.agg(F.count("id"), F.sum("age"), F.countDistinct("id")).first() == (120_000, sum(i % 90 for i in range(120_000)), 120_000)
        assert feed.filter("error is not null").isEmpty()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_an_object_longer_than_several_splits(spark, tmp_path, small_splits):
    rows = [{"id": "1", "name": "a"}, {"id": "2", "name": '}"\\' * 2000, "city": "{[" * 500}, {"id": "3"}]
    path = tmp_path / "long.json"
    path.write_text("\ufeff" + json.dumps(rows), encoding="utf-8")
    assert split(spark, str(path)) == [("1", "a", None), ("2", '}"\\' * 2000, "{[" * 500), ("3", None, None)]


@pytest.mark.parametrize(
    "text",
    ['[{"id": "1"}, {"id": "2"', '[{"id": "1"}', '[{"id": "1"}, ', '[{"id": "1"} {"id": "2"}]', '[{"id": "1"},, {"id": "2"}]',
     '[{"id": "1"}, {"id": "2}]', '[{"id": "1"}, 5, {"id": "2"}]', '[{"id": "1"}, 5]', '[{"id": "1"}, {"id": bad}]', '[[{"id": "1"}]]',
     '[{"id": "1"}]]', '[{"id": "1"}] x', '{"id": "1"', "[", '[{"id": "1"}],', "nothing"],
)
def test_what_is_no_json_is_an_error(spark, tmp_path, small_splits, text):
    filler = "".join(f'{{"id": "{i}"}}, ' for i in range(60))
    path = tmp_path / "spoilt.json"
    path.write_text(text.replace("[", "[" + filler, 1) if len(text) % 2 else text)
    with pytest.raises(Exception, match="no JSON"):
        tables.read_json_feed(spark, str(path), CLIENTS, lines=False).select("id", "error").collect()


def test_missing_and_empty_feeds(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.read_json_feed(spark, str(tmp_path / "none.json"), CLIENTS, lines=False)
    (tmp_path / "e.json").write_text("[]")
    assert tables.read_json_feed(spark, str(tmp_path / "e.json"), CLIENTS, lines=False).isEmpty()
