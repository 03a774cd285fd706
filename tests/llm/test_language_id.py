import numpy as np
from pyspark.sql import functions as F

from shopmeter.llm import language_id
from shopmeter.llm.common import held_out
from shopmeter.llm.language_id import grams, identify, learn
from shopmeter.llm.queries import op9_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op9_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    rows = got.filter("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 100
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97
    assert got.count() == 1000 and all(0 <= r.score <= 1 for r in got.collect())


def test_fold_is_that_of_the_library(spark):
    import zlib

    rows = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_grams_by_brute_force():
    texts = ["Ab c", "", "12", "é-ab", "x" * 5]
    owner, keys, lettered = grams(texts)
    expected = 0
    for t in texts:
        clean = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        for w in clean:
            expected += sum(max(0, len(w) + 2 - n + 1) for n in (2, 3, 4))
    assert len(keys) == expected
    assert lettered.tolist() == [True, False, False, True, True]


def test_filters_hold_every_learnt_gram_and_say_which_languages(spark):
    docs = spark.createDataFrame(
        [(i, w, l) for i, (w, l) in enumerate([("alpha beta", "aa"), ("gamma beta", "bb"), ("", "bb"), (None, "cc")])],
        "doc_id long, text string, lang string",
    )
    filters = learn(docs)
    assert filters.languages == ["aa", "bb"]
    for word, mask in (("alpha", 1), ("beta", 3), ("gamma", 2)):
        _, keys, _ = grams([word])
        found = np.bitwise_and.reduce([filters.slots[at, 0] for at in language_id.positions(keys)])
        assert all(int(f) & mask for f in found)


def test_nulls_junk_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(1, "hello world the", "en", 1), (2, "salut monde le", "fr", 1), (3, None, "fr", 2), (4, "1234 !!", None, 3),
         (None, "le monde", None, 4), (5, "", "en", 5), (5, "", "en", 5), (6, "Ж" * 70000, "en", 6)],
        "doc_id long, text string, lang string, score int",
    )
    rows = identify(docs, learn(docs)).collect()
    assert len(rows) == 8
    by = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert by[1][0] == "en" and by[2][0] == "fr" and by[None][0] == "fr"
    assert by[3] == by[4] == by[5] == ("und", 0.0)
    none = docs.limit(0)
    assert identify(none, learn(none)).count() == 0
    assert {r.lang_pred for r in identify(docs, learn(none)).collect()} == {"und"}


def test_more_languages_than_a_word_has_bits(spark):
    rows = [(i, chr(0x4E00 + 7 * i) * 6, f"l{i:03}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = identify(docs, learn(docs)).collect()
    assert all(r.lang_pred == f"l{r.doc_id:03}" for r in got)


def test_order_of_rows_does_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = learn(docs), learn(docs.orderBy(F.desc("doc_id")).repartition(5))
    assert (a.slots == b.slots).all()


def test_rows_without_key_and_repeats_keep_to_the_sample(spark):
    rows = [(None, f"text {i}", "aa") for i in range(3000)] + [(7, "same", "aa")] * 1500 + [(i, "few", "bb") for i in range(20)]
    languages, picked = language_id.drawn(spark.createDataFrame(rows, "key long, text string, lang string"), 300)
    got = [(r.lang, r.text) for r in picked.collect()]
    texts = [text for lang, text in got if lang == "aa"]
    assert languages == ["aa", "bb"] and got.count(("bb", "few")) == 20
    assert 200 < len(texts) < 400 and len(set(texts)) == len(texts)


def scored_gram_by_gram(text, filters):
    _, keys, lettered = grams([text])
    if not lettered[0]:
        return "und", 0.0
    found = []
    for key in keys:
        at = [int(p[0]) for p in language_id.positions(np.array([key], np.uint64))]
        found.append([[int(part) for part in filters.slots[a]] for a in at])
    shares = []
    for number in range(len(filters.languages)):
        hits = sum(all(slot[number // 64] >> (number % 64) & 1 for slot in slots) for slots in found)
        wrong = float(filters.false_rate[number])
        shares.append((hits / len(keys) - wrong) / (1 - min(wrong, 0.999)))
    best = max(range(len(shares)), key=lambda i: (shares[i], -i))
    return filters.languages[best], min(1.0, max(0.0, shares[best]))


def test_scores_gram_by_gram(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    some = docs.orderBy("doc_id").limit(25).select("doc_id", F.substring("text", 1, 400).alias("text"))
    some = some.unionByName(spark.createDataFrame([(-1, None), (-2, "77 !"), (-3, "qqq zzz xxx")], some.schema))
    # Beyond eight and beyond 64 languages the filters are wider.
    many = spark.createDataFrame(
        [(i, f"{chr(97 + i % 26) * 3}{chr(97 + i // 26) * 2} the", f"l{i:03}") for i in range(90)],
        "doc_id long, text string, lang string",
    )
    for filters in (learn(docs.filter(~held_out())), learn(many.filter("doc_id < 20")), learn(many)):
        for row in identify(some.select("doc_id", "text"), filters, carry=("text",)).collect():
            lang, score = scored_gram_by_gram(row.text or "", filters)
            assert row.lang_pred == lang and abs(row.score - score) < 1e-9


def test_carried_text_and_columns_come_back(spark):
    rows = [(1, "the cat sat", "en", 5), (2, None, "en", 6), (3, "", None, None), (3, "le chat dort", "fr", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, body string, lang string, text int")
    filters = learn(docs, text="body")
    found = identify(docs, filters, text="body", carry=("text", "body", "lang"))
    assert found.columns == ["doc_id", "lang_pred", "score", "text", "body", "lang"]
    assert sorted(map(repr, ((r.doc_id, r.body, r.lang, r.text) for r in found.collect()))) == sorted(map(repr, rows))
