import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

import __spark_entry__ as registered
import corpus_pipeline
from tests.llm.test_near_copies import brute as near_brute
from tests.llm.test_repeats import brute as repeat_brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    """Each stage's rows over the smallest tables, and its input."""
    folder = "/root/testdata/sf0.001"
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = ([r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()])
    return seen


def test_stages_hand_on_the_columns_of_documents(outputs):
    for name, (before, _) in outputs.items():
        assert list(before[0]) == COLUMNS, name


def test_language_keeps_documents_with_letters(outputs):
    before, after = outputs["language"]
    kept = {r["doc_id"] for r in after}
    assert all(r in before for r in after)
    for r in before:
        if sum(c.isalpha() for c in r["text"] or "") > 0.6 * len(r["text"] or " "):
            assert r["doc_id"] in kept


def test_near_copies_leave_the_first_of_a_group(outputs):
    before, after = outputs["near_copies"]
    expected = {k for k, (_, _, kept) in near_brute([(r["doc_id"], r["text"]) for r in before], 5).items() if kept}
    assert {r["doc_id"] for r in after} == expected and len(after) == len(expected) < len(before)


def test_repeats_are_cut_to_whole_characters(outputs):
    before, after = outputs["repeats"]
    found = {r["doc_id"]: r for r in after}
    for r, (spans, _) in zip(before, repeat_brute([r["text"] for r in before]), strict=True):
        raw, at, text = r["text"].encode(), 0, b""
        for low, high in spans:
            while low < high and raw[low] & 0xC0 == 0x80:
                low += 1
            while high > low and high < len(raw) and raw[high] & 0xC0 == 0x80:
                high -= 1
            text, at = text + raw[at:low], high
        text += raw[at:]
        if text:
            row = found.pop(r["doc_id"])
            assert (row["text"], row["n_chars"], row["source"]) == (text.decode(), len(text.decode()), r["source"])
    assert not found


def test_mix_repeats_or_drops_whole_documents(outputs):
    before, after = outputs["mixing"]
    times = Counter(r["doc_id"] for r in after)
    texts = {r["doc_id"]: r["text"] for r in before}
    assert max(times.values()) <= 3 and all(r["text"] == texts[r["doc_id"]] for r in after)
    words = sum(len(t.split()) for t in texts.values())
    assert abs(sum(len(r["text"].split()) for r in after) - words) < 0.3 * words


def test_tokens_are_those_of_the_library(outputs):
    before, after = outputs["tokens"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in before}
    assert len(before) == len(after)
    for r in after:
        ids = library.encode(texts[r["doc_id"]])
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_run_equals_the_stages(spark, outputs):
    rows = registered.queries()["pipeline"](spark, "/root/testdata/sf0.001").collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in rows) == Counter((r["doc_id"], r["ids_sha256"]) for r in outputs["tokens"][1])


def test_awkward_rows(spark, tmp_path):
    draw = random.Random(1)
    text = lambda: " ".join("".join(draw.choices("abcdefgh", k=4)) for _ in range(60))
    same, long = text(), " ".join(text() for _ in range(300))
    rows = [(None, same, "en", "a", 1, 7), (1, None, "en", "a", 1, 7), (2, "", None, None, 1, 7), (3, "12 34 !!", "en", None, None, 7),
            (4, long, "en", "b", 1, 7), (5, same + " x", "en", "b", 1, 7), (5, same + " x", "en", "b", 1, 7),
            (6, text(), None, None, None, None), (7, text(), "en", "c", 1, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {None, 4, 5, 6, 7} and {4, 7} & {r.doc_id for r in got}
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_columns_with_names_that_stages_use(spark, tmp_path):
    extra = "lang_pred score named_score kept spans n_bytes _turn turn row key hash size target times carry ids n_tokens id th a.b".split()
    draw = random.Random(2)
    rows = [(i, " ".join("".join(draw.choices("abcdefgh", k=4)) for _ in range(40)), "en", "s", 1, *extra) for i in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = docs.collect()
        assert got and docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra]
        assert all(list(r)[5:] == extra for r in got), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(got)


def test_texts_travel_once(spark):
    """Of the rows that go to Python or through the window, only one column holds the texts."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, kind in (("language", "MapInArrow"), ("near_copies", "Window"), ("repeats", "MapInArrow")):
        node = dict(corpus_pipeline.STAGES)[name](spark, docs, "")._jdf.queryExecution().optimizedPlan()
        while node.nodeName() != kind:
            node = node.children().apply(0)
        assert node.children().apply(0).schema().json().count('"name":"text"') == 1, name
