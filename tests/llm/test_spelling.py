import random
import re
import zlib
from collections import Counter

import pytest

from shopmeter.llm.spelling import misspelt, neighbours, runs, spelling_variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    out = {}
    for word, n in counts.items():
        close = [(-m, v) for v, m in counts.items() if near(word, v)]
        best = min(close, default=None)
        fits = best and -best[0] >= 2 * n
        out[word] = (best[1] if fits else None, n, len(close), -best[0] if fits else None)
    rows = []
    for word, (form, n, many, form_n) in out.items():
        root = word
        while out[root][0] is not None:
            root = out[root][0]
        rows.append((word, form, root, n, many, form_n))
    return sorted(rows)


def brute_words(rows):
    counts = Counter()
    for key, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            at = h % len(run)
            counts[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def test_registered_query_equals_its_sql(agrees):
    rows = agrees("op13_spelling", "/root/testdata/sf0.001", ["documents"])
    assert any(r[0] is not None for r in rows)


@pytest.mark.parametrize(("alphabet", "parts"), [("ab", 1), ("abé", 5), ("abcdefgh", 16)])
def test_neighbours_by_brute_force(spark, alphabet, parts):
    draw = random.Random(len(alphabet))
    counts = {}
    for _ in range(250):
        word = "".join(draw.choice(alphabet) for _ in range(draw.randrange(1, 8)))
        counts[word] = draw.choice([1, 2, 3, 8, 20, 50, 200])
    counts |= {"a" * n: n for n in range(1, 14)} | {"b" * 70 + c: 3 for c in alphabet}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = {r.word: tuple(r)[1:] for r in neighbours(words).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    expected = {w: (n, many, form, form_n) for w, form, _, n, many, form_n in brute(counts)}
    assert found == expected


def test_whole_texts_by_brute_force(spark):
    draw = random.Random(7)
    pool = ["".join(draw.choice("abcÉé") for _ in range(draw.randrange(1, 9))) for _ in range(120)]
    rows = [(i, " ,-\n1×".join(draw.choice(pool) for _ in range(80)).upper() if i % 3 else "_".join(pool)) for i in range(60)]
    rows += [(None, "Étoile étoile étoile"), (None, "étoile ÿeuxÀ"), (5, None), (6, ""), (7, "7 日本"), (8, "seconde " * 40_000), (8, "x" * 30_000)]
    rows += [(9, "y" * 20_000 + " " + "y" * 19_999)] * 4
    docs = spark.createDataFrame([(k, t, "w", 1) for k, t in rows], "doc_id long, text string, word string, key int").repartition(6)
    got = sorted(tuple(r) for r in spelling_variants(misspelt(runs(docs))).collect())
    assert got == brute(brute_words(rows))


def test_chains_of_forms_reach_their_end(spark):
    chain = ["abcde", "abcdf", "abcgf", "abhgf", "aihgf", "jihgf"]
    rows = [(w,) for i, w in enumerate(chain) for _ in range(3 * 2**i)] + [(None,)] * 5
    found = {r.word: r.root for r in spelling_variants(spark.createDataFrame(rows, "word string")).collect()}
    assert all(found[w] == "jihgf" for w in chain)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    empty = spelling_variants(misspelt(runs(docs)))
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]
