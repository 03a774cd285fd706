import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from shopmeter.llm.fingerprints import edited, fingerprint_neighbours, fingerprints, likeness
from shopmeter.llm.queries import op10_fingerprints
from shopmeter.llm.words import sets, shingles, words

SF = "/root/testdata/sf0.001"


def plain_words(text, lower=True):
    import re

    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def plain_shingles(text, size):
    found = plain_words(text)
    if not found:
        return []
    return [tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))]


def test_words_and_shingles_by_brute_force():
    draw = random.Random(1)
    alphabet = ["a", "B", "cc", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\xa0", "é", "É", "\0", "中"]
    texts = ["", " ", "a", "a b", None] + ["".join(draw.choices(alphabet, k=draw.randrange(80))) for _ in range(300)]
    array = pa.array(texts, pa.string())
    for lower in (True, False):
        owner, hashes = words(array, lower)
        expected = [(i, w) for i, t in enumerate(texts) for w in plain_words(t or "", lower)]
        assert owner.tolist() == [i for i, _ in expected]
        assert len({(h, w) for h, (_, w) in zip(hashes.tolist(), expected, strict=True)}) == len({w for _, w in expected})
    for size in (1, 2, 5):
        of, hashes = shingles(array, size)
        grams = [(i, g) for i, t in enumerate(texts) for g in plain_shingles(t or "", size)]
        assert np.bincount(of, minlength=len(texts)).tolist() == [len(plain_shingles(t or "", size)) for t in texts]
        assert len(set(hashes.tolist())) == len({g for _, g in grams})
        values, ends = sets(array.slice(3), size)
        assert np.diff([0, *ends]).tolist() == [len(set(plain_shingles(t or "", size))) for t in texts[3:]]


def test_likeness_estimates_resemblance():
    draw = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    for size in (40, 600, 5000):
        errors = []
        for share in (0.0, 0.3, 0.7, 0.95):
            base = draw.choices(vocabulary, k=size)
            for _ in range(8):
                cut = int(size * share)
                other = base[:cut] + draw.choices(vocabulary, k=size - cut)
                a, b = " ".join(base), " ".join(other)
                one, two = set(plain_shingles(a, 5)), set(plain_shingles(b, 5))
                got = likeness(fingerprints(pa.array([a])), fingerprints(pa.array([b])))[0]
                errors.append(got - len(one & two) / len(one | two))
        assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.2


def test_registered_query_by_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in op10_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    errors = []
    for i, (key, text) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        changed = edited(text, after)
        k = len(text) // 4
        assert changed == text[: len(text) - k] + after[:k]
        row = got[key]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert [row.fingerprint, row.edited_fingerprint] == fingerprints(pa.array([text, changed]))
        for found, other in ((row.near_edited, changed), (row.near_next, after)):
            one, two = set(plain_shingles(text, 5)), set(plain_shingles(other, 5))
            errors.append(found - (len(one & two) / len(one | two) if one | two else 1.0))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.25


def test_equal_texts_have_equal_fingerprints(spark):
    rows = op10_fingerprints(spark, SF).select("doc_id", "fingerprint").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by = {}
    for r in rows:
        assert by.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_nulls_repeats_long_texts_and_small_tables(spark):
    rows = [(None, "x y", 0), (1, None, 1), (2, "", 2), (2, "", 2), (3, "a b c d e f g h " * 40000, 3), (9, "tail end", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    got = fingerprint_neighbours(docs).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert by[None].edited_text == "x y" and by[9].edited_text == "tail e" + "x "
    assert by[1].fingerprint == by[2].fingerprint == "empty" and by[1].near_edited == 1.0 and by[1].near_next == 1.0
    assert by[9].near_next == pytest.approx(0, abs=0.3)
    alone = fingerprint_neighbours(docs.filter("doc_id = 9")).collect()
    assert [(r.near_next, r.edited_text) for r in alone] == [(1.0, "tail eta")]
    assert fingerprint_neighbours(docs.limit(0)).count() == 0


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_complete_whether_exchanges_are_reused_or_not(spark, reuse):
    draw = random.Random(12)
    key = lambda i: None if i % 3 == 0 else i // 4 if i % 5 else 77
    rows = [(key(i), "same beginning " * (i % 4) + f"w{draw.randrange(900)} " * draw.randrange(6)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        got = sorted((repr(r.doc_id), r.n_chars, r.edited_text) for r in fingerprint_neighbours(docs).collect())
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    following = ordered[1:] + ordered[:1]
    assert got == sorted((repr(k), len(t), edited(t, f)) for (k, t), (_, f) in zip(ordered, following, strict=True))
