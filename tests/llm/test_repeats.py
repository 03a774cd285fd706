import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from shopmeter.llm import repeats as module
from shopmeter.llm.queries import op7_repeats
from shopmeter.llm.repeats import repeated_starts, repeats


def brute(texts, length=200):
    seen = Counter()
    raws = [(t or "").encode() for t in texts]
    for raw in raws:
        seen.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    out = []
    for raw in raws:
        covered = np.zeros(len(raw) + 1, np.int64)
        for i in range(len(raw) - length + 1):
            if seen[raw[i : i + length]] > 1:
                covered[i] += 1
                covered[i + length] -= 1 if i + length <= len(raw) else 0
        covered = np.cumsum(covered)[: len(raw)] > 0 if len(raw) else np.zeros(0, bool)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int), [0]])))
        spans = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        out.append((spans, bytes(np.frombuffer(raw, np.uint8)[~covered])))
    return out


def check(spark, texts, **settings):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: ([(s.low, s.high) for s in r.spans], bytes(r.kept)) for r in repeats(docs, **settings).collect()}
    for i, expected in enumerate(brute(texts, settings.get("length", 200))):
        assert got[i] == expected, i
    return got


def test_intervals_by_brute_force():
    draw = random.Random(1)
    for begin in (7, 14, 112):
        for _ in range(15):
            strings = [bytes(draw.choices(b"ab\0", k=draw.randrange(1, 80))) for _ in range(draw.randrange(1, 12))]
            strings += [s[: draw.randrange(1, 80)] for s in strings[:3]]
            length = draw.choice([3, 8, 20, 30])
            places, groups = repeated_starts(strings, length, begin)
            joined, begins = b"", []
            for s in strings:
                begins.append(len(joined))
                joined += s + b"\xff"
            by = {}
            for b, s in zip(begins, strings, strict=True):
                for i in range(len(s) - length + 1):
                    by.setdefault(s[i : i + length], []).append(b + i)
            expected = sorted(sorted(v) for v in by.values() if len(v) > 1)
            found = sorted(sorted(g.tolist()) for g in np.split(places, groups[1:])) if len(places) else []
            assert found == expected


def passages(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdeé中", k=draw.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (20, 40, 41, 60, 120, 400)]
    texts = []
    for _ in range(40):
        parts = [text(draw.randrange(1, 60))]
        for _ in range(draw.randrange(0, 4)):
            one = draw.choice(shared)
            cut = draw.randrange(0, len(one) // 3)
            parts += [one[cut : len(one) - draw.randrange(0, len(one) // 4 + 1)], text(draw.randrange(0, 30))]
        texts.append("".join(parts))
    texts += [texts[0], texts[1][:-1], "x" * 150, "x" * 199, "x" * 200, "x" * 450, "y" * 200, "z" * 201, "ab" * 300, "", None, " "]
    texts += ["\0" * 210, ("line\n" * 100), text(500) + shared[3] + text(20) + shared[3]]
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_by_brute_force(spark, seed):
    got = check(spark, passages(seed))
    assert any(spans for spans, _ in got.values())


def test_small_blocks_wide_anchors_and_parts(spark, monkeypatch):
    texts = passages(3)
    check(spark, texts, contexts=1)  # every anchor goes by digests
    check(spark, texts, contexts=4)
    check_parts(texts)
    monkeypatch.setattr(module, "PART", 300)
    check_parts(texts)


def check_parts(texts):
    """Texts in parts have the anchors of whole texts, and every window has one."""
    import pyarrow as pa

    from shopmeter.llm.repeats import anchors, text_anchors

    of, at, marks, _, first, last = text_anchors(pa.array(texts, pa.string()))
    found, windows = {}, {}
    for i, p, m, a, b in zip(of.tolist(), at.tolist(), marks.tolist(), first.tolist(), last.tolist(), strict=True):
        found.setdefault(i, set()).add((p, m))
        windows.setdefault(i, []).extend(range(a, b + 1))
    for i, t in enumerate(texts):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        low, high = np.zeros(len(raw), np.int64), np.full(len(raw), len(raw))
        a, m, *_ = anchors(raw, low, high, 0, len(raw))
        assert found.get(i, set()) == set(zip(a.tolist(), m.tolist(), strict=True))
        assert sorted(windows.get(i, [])) == list(range(len(raw) - 199))


def test_other_lengths(spark):
    check(spark, passages(4)[:25], length=64)
    check(spark, passages(4)[:25], length=301)
    with pytest.raises(ValueError):
        repeats(spark.createDataFrame([], "doc_id long, text string"), length=63)


def test_registered_query_by_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    got = {r.doc_id: r for r in op7_repeats(spark, folder).collect()}
    assert len(got) == len(docs)
    for (key, text), (spans, kept) in zip(docs, brute([t for _, t in docs]), strict=True):
        row = got[key]
        assert (row.n_bytes, row.n_removed, row.n_spans) == (len(text.encode()), sum(b - a for a, b in spans), len(spans))
        assert row.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_nulls_repeats_extra_columns_and_empty_tables(spark):
    one, two = "abc " * 60, "".join(random.Random(9).choices("qwertzuiop", k=500))
    rows = [(None, two, 1, "x"), (4, two, 1, "x"), (7, one[:100], 1, "x"), (8, None, 1, "x"), (9, "k" + two[:250], 1, "x"),
            (9, "other text under the same key", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, spans string")
    got = repeats(docs).collect()
    assert len(got) == 6
    by = {(r.doc_id, r.n_bytes): ([(s.low, s.high) for s in r.spans], bytes(r.kept)) for r in got}
    assert by[None, 500] == by[4, 500] == ([(0, 500)], b"")
    assert by[9, 251] == ([(1, 251)], b"k") and by[9, 29][0] == [] and by[8, 0] == ([], b"")
    assert repeats(docs.limit(0)).count() == 0
