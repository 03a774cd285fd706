import random

import public_tokenizers
import pytest
import sentencepiece

from shopmeter.llm import sentencepiece_codec
from shopmeter.llm.queries import model_file
from shopmeter.llm.sentencepiece_codec import encode_decode

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


def coded(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = encode_decode(docs, model_file(MODEL)).collect()
    return {r.doc_id: (list(r.ids), r.decoded) for r in rows}


def awkward():
    draw = random.Random(7)
    alphabet = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "▁", "é", "ß", "中", "\U0001f600", "\0", "<s>", "</s>",
                "<unk>", "<0x41>", "!!", "0", "1", "\r\n", "́", "﻿", "　", "Ω", "​"]
    texts = ["", " ", "  ", "\n", " \n", "\n\n ", "▁", " a", "a ", "a  b", "a   ", "a" * 5000, "ab" * 3000,
             " " * 1000, "abc " * 500 + " " * 37 + "x", "\n" * 40, "▁▁x", "一" * 300]
    texts += ["".join(draw.choices(alphabet, k=draw.randrange(1, 60))) for _ in range(1500)]
    texts += ["".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(32, 0x2FFF), draw.randrange(0x10000, 0x1FFFF)]))
                      for _ in range(40)) for _ in range(200)]
    texts += ["".join(draw.choices("abcdefghinorst", k=300)) for _ in range(50)]
    return texts


def test_equals_the_library(spark, library):
    texts = awkward()
    found = coded(spark, texts)
    for i, text in enumerate(texts):
        ids = library.encode(text)
        assert found[i] == (ids, library.decode(ids)), repr(text)


def test_whole_documents_and_small_caches(spark, library, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in encode_decode(docs, model_file(MODEL)).collect():
        ids = library.encode(texts[r.doc_id])
        assert (list(r.ids), r.decoded) == (ids, library.decode(ids))
    monkeypatch.setattr(sentencepiece_codec, "CACHED_WORDS", 5)
    monkeypatch.setattr(sentencepiece_codec, "PART_CHARS", 20)
    encoder = sentencepiece_codec.Encoder(model_file(MODEL))
    for text in [*texts.values()][:40] + ["one  two three    four five six seven eight   nine ten " * 3]:
        ids = []
        for part in encoder.parts(text):
            encoder.learn(set(part))
            ids += [int(i) for x in encoder.encode(part)[0] for i in x]
        assert ids == library.encode(text)


def test_nulls_repeats_extra_columns_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(None, None, [1]), (1, "", [2]), (1, "same", [3]), (1, "same", [3])], "doc_id long, text string, ids array<int>"
    )
    rows = encode_decode(docs, model_file(MODEL)).collect()
    assert sorted(len(r.ids) for r in rows) == [0, 0, 1, 1]
    assert encode_decode(docs.limit(0), model_file(MODEL)).count() == 0


def test_other_models_are_refused(spark):
    with pytest.raises(TypeError):
        encode_decode(spark.createDataFrame([], "doc_id long, text string"), "a path")
