import math
import random

import pytest

from shopmeter.llm import mixing
from shopmeter.llm.mixing import mix, targets, text_size


def shares(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        by = sum(weight[s] for s in open_)
        share = {s: rest * weight[s] / by for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return share | {s: float(most * sizes[s]) for s in full}
        full |= over


@pytest.mark.parametrize("seed", range(6))
def test_targets_by_resharing(spark, seed):
    draw = random.Random(seed)
    sizes = {f"s{i}" if i else None: draw.choice([0, 1, 7, 100, 5000, 10**6]) for i in range(draw.randrange(1, 30))}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in targets(df).collect()}
    assert set(got) == set(sizes)
    for s, t in shares(sizes).items():
        assert math.isclose(got[s], t, rel_tol=1e-9, abs_tol=1e-9)
        assert got[s] <= 3 * sizes[s]
    assert math.isclose(sum(got.values()), sum(sizes.values()), rel_tol=1e-9)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_query_equals_its_sql(agrees, sf):
    rows = agrees("op3_mixing", f"/root/testdata/{sf}", ["documents"])
    assert rows


def test_taken_words_come_near_the_target(spark):
    rows = [(i, "w " * (1 + i % 40), f"s{i % 7}" if i % 11 else None) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).collect()
    assert len(got) == 4000
    by = {}
    for r in got:
        assert 0 <= r.times <= 3
        by.setdefault(r.row.source, [r.target, 0])[1] += r.size * r.times
    assert all(abs(t - n) <= 41 for t, n in by.values())
    again = {r.row.doc_id: r.times for r in mix(docs.orderBy("text").repartition(3)).collect()}
    assert again == {r.row.doc_id: r.times for r in got}
    other = {r.row.doc_id: r.times for r in mix(docs, seed="x").collect()}
    assert other != again


def test_no_source_limit_changes_the_result(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few = {r.row.doc_id: r.times for r in mix(docs).collect()}
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert {r.row.doc_id: r.times for r in mix(docs).collect()} == few


def test_nulls_repeats_extra_columns_and_empty_tables(spark):
    schema = "doc_id long, text string, source string, size string, hash int, times int"
    rows = [(None, "a b", None, "x", 1, 2), (1, None, "a", "x", 1, 2), (2, "", "a", "x", 1, 2), (3, "w " * 30000, "b", "x", 1, 2),
            (4, "one two", "c", "x", 1, 2), (4, "one two", "c", "x", 1, 2)]
    docs = spark.createDataFrame(rows, schema)
    got = mix(docs).collect()
    assert len(got) == 6 and all(r.row["size"] == "x" for r in got)
    by = {(r.row.doc_id, r.row.source): r for r in got}
    assert by[1, "a"].size == 0 and by[1, "a"].target == 0.0
    assert by[None, None].size == 2
    assert mix(docs.limit(0)).count() == 0


def test_words_are_runs_between_ascii_blanks(spark):
    df = spark.createDataFrame([("a\tb\x0bc\rd  e\n",), ("\x1c \xa0",), (" ",), (None,), ("中 文",)], "text string")
    assert [r.n for r in df.select(text_size().alias("n")).collect()] == [5, 2, 0, 0, 2]


def test_plan_has_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_rows_without_a_key_and_equal_rows_do_not_move_as_one(spark, tmp_path):
    rows = [(None if i % 2 else i, f"w{i} " * (1 + i % 9), "c") for i in range(1500)]
    rows += [(None, "same old words", "c")] * 1500 + [(7, "same old words", "b")] * 3000 + [(i, "x y", "a") for i in range(3000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/docs")
    taken, target = {}, {}
    for r in mix(spark.read.parquet(f"{tmp_path}/docs")).collect():
        taken[r.row.source] = taken.get(r.row.source, 0) + r.size * r.times
        target[r.row.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 9 for s in target), (taken, target)
