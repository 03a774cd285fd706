import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopmeter.llm.checksums import crc32_joined, crc32_with_byte, crc32_words
from shopmeter.llm.resampling import cutoff, draw, score


def plain_features(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(found), found + [f"{a} {b}" for a, b in zip(found, found[1:])]


def brute(rows, target, share, least, buckets):
    described = [(k, *plain_features(t)) for k, t in rows]
    place = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, _, features in described:
        for f in features:
            s[place(f)] += 1
    for text in target:
        for f in plain_features(text)[1]:
            t[place(f)] += 1
    out = []
    for k, words, features in described:
        total = 0
        for f in features:
            b = place(f)
            total += math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets))))
        weight = total // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append((k, words, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = order[: share * len(order) // 100]
    ranked = [(*r, i + 1) for i, r in enumerate(drawn)]
    left = list(out)
    for r in drawn:
        left.remove(r)
    return sorted(ranked + [(*r, None) for r in left], key=str)


def test_registered_query_equals_its_sql(agrees):
    rows = agrees("op11_resampling", "/root/testdata/sf0.001", ["documents", "benchmark"])
    assert any(r[2] is not None for r in rows)


def texts(seed, count):
    out = random.Random(seed)
    alphabet = ["a", "Bc", "der", "œuvre", "日本", "x1", "42", "Ünder", "w" * 90]
    return [" -\n,\x00_"[out.randrange(6)].join(out.choice(alphabet) for _ in range(out.randrange(0, 60))) for _ in range(count)]


@pytest.mark.parametrize("share", [0, 25, 100])
def test_draw_by_brute_force(spark, share):
    rows = list(enumerate(texts(1, 150))) + [(7, "a b " * 30)] * 40 + [(None, "der x1 " * 12)] * 5 + [(900, None), (901, ""), (902, "é")]
    rows += [(902, "a " * 300_000)]
    docs = spark.createDataFrame([(k, t, "z", 1) for k, t in rows], "doc_id long, text string, key string, row int").repartition(7)
    target = spark.createDataFrame([(t,) for t in [*texts(2, 20), None]], "text string")
    got = draw(score(docs, target, buckets=97), share)
    assert got.columns == ["doc_id", "words", "n_features", "weight", "score", "rank"]
    expected = brute(rows, texts(2, 20), share, 20, 97)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected


def test_carried_columns_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b " * 20, 5, "k")], "doc_id long, text string, _salt int, `row.c0` string")
    scored = score(docs, docs.select("text"), carry=("text", "row.c0"))
    drawn = draw(scored, 100).first()
    assert drawn["text"] == "a b " * 20 and drawn["row.c0"] == "k" and drawn["rank"] == 1
    with pytest.raises(ValueError, match="repeat"):
        score(docs.withColumn("weight", F.lit(1)), docs, carry=("weight",))
    with pytest.raises(ValueError, match="reserved"):
        draw(score(docs, docs, carry=("_salt",)), 100)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert draw(score(docs.limit(0), docs), 25).count() == 0
    assert draw(score(docs, docs.limit(0)), 100).first()["rank"] == 1


def test_cutoff_finds_every_place(spark):
    draws = random.Random(5)
    rows = [(draws.randrange(6), draws.randrange(2), draws.randrange(3), draws.randrange(2)) for _ in range(300)]
    places = spark.createDataFrame(rows, "o1 long, o2 long, o3 long, o4 long").repartition(9)
    ordered = sorted(rows)
    for wanted in (1, 2, 77, 150, 299, 300):
        assert cutoff(places, wanted) == ordered[wanted - 1]


def test_checksums_equal_the_library():
    out = random.Random(4)
    words = [bytes(out.randrange(256) for _ in range(out.choice([0, 1, 3, 17, 64, 65, 1000]))) for _ in range(300)]
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes) - sizes
    found = crc32_words(np.frombuffer(b"".join(words), np.uint8), starts, sizes)
    assert found.tolist() == [zlib.crc32(w) for w in words]
    joined = crc32_joined(crc32_with_byte(found[:-1], 0x20), found[1:], sizes[1:])
    assert joined.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:])]
    assert len(crc32_words(np.zeros(0, np.uint8), np.zeros(0, int), np.zeros(0, int))) == 0
