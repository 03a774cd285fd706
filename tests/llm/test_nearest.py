import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shopmeter.llm.nearest import Quantised, nearest


def brute(rows, k):
    kept = {}
    for key, v, asks in rows:
        if key is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        v = [float(np.float32(x)) for x in v]
        old = kept.get(key)
        kept[key] = (min(v, old[0]) if old else v, asks or bool(old and old[1]))
    out = {}
    for q, (a, asks) in kept.items():
        if not asks:
            continue
        near = []
        for c, (b, _) in kept.items():
            if c != q and len(a) == len(b):
                score = 0.0
                for x, y in zip(a, b, strict=True):
                    score += x * y
                near.append((-score, c))
        for rank, (score, c) in enumerate(sorted(near)[:k], 1):
            out[q, rank] = (c, -score)
    return out


@pytest.mark.parametrize("blocks", [(2048, 1024), (7, 3)])
def test_awkward_vectors_by_brute_force(spark, blocks):
    draw = random.Random(4)
    vectors = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    vectors += [vectors[3]] * 30 + [[1e-30] * 8, [1e18] * 8, [0.0] * 8, None, [], [float("nan")] * 8, [1.0, None] * 4,
                [float("inf")] + [0.0] * 7, [1.0, 2.0], [2.0, 1.0], [-1.0] * 8]
    rows = [(i if i != 70 else None, v, i % 3 == 0) for i, v in enumerate(vectors)]
    rows += [(5, vectors[6], False), (6, vectors[6], True), (6, vectors[6], True)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, asks boolean").withColumn("score", F.lit("x"))
    got = nearest(df, F.col("asks"), k=5, block=blocks[0], query_block=blocks[1]).collect()
    assert {(r.query_id, r["rank"]): (r.near_id, r.score) for r in got} == brute(rows, 5)
    assert len(got) == len(brute(rows, 5))


def test_error_bound_holds():
    draw = np.random.default_rng(1)
    for scale in (1e-20, 1, 1e10):
        a, b = draw.normal(size=(50, 64)) * scale, draw.standard_t(1.5, size=(70, 64))
        x, y = Quantised(a), Quantised(b)
        near = (x.values.astype(float) @ y.values.T.astype(float)) * x.scale[:, None] * y.scale
        bound = np.outer(x.lost, y.norm) + np.outer(x.kept, y.lost)
        assert (np.abs(a @ b.T - near) <= bound * (1 + 1e-9)).all()


def test_registered_query_equals_its_sql(agrees):
    rows = agrees("op5_nearest", "/root/testdata/sf0.01", ["embeddings"])
    assert len(rows) == 25 * 20


def test_empty_tables_and_no_queries(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(empty, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert nearest(one, F.lit(True)).count() == 0 and nearest(one, F.lit(False)).count() == 0


def test_registered_query_keeps_every_vector_of_an_id(spark, agrees, tmp_path):
    draw = random.Random(8)
    rows = [(i % 45, [float(draw.randint(-9, 9)) for _ in range(4)]) for i in range(120)]
    rows += rows[:50] + [(None, [1.0] * 4), (20, None), (40, [0.0] * 4), (20, [3.0, 4.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/parts")
    table = pq.read_table(f"{tmp_path}/parts")
    pq.write_table(table, f"{tmp_path}/embeddings.parquet")
    assert len(agrees("op5_nearest", str(tmp_path), ["embeddings"])) == 3 * 20
