import random

import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer, pre_tokenizers

from shopmeter.llm import token_counts
from shopmeter.llm.queries import model_file
from shopmeter.llm.token_counts import count_tokens, frequent_pre_tokens

FILE = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(FILE))


def expected(library, text):
    return len((text or "").encode()), len(library.encode(text or "", add_special_tokens=False))


def test_settled_characters_split_alike():
    split = regex.compile(token_counts.PATTERN).findall
    own = pre_tokenizers.ByteLevel(add_prefix_space=False)
    settled = regex.compile(f"[{token_counts.SETTLED}]")
    chars = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x20000)]) if settled.match(c)]
    for i in range(0, len(chars), 500):
        text = "".join(f"a{c}1{c}!{c} {c}x{c}{c} \n" for c in chars[i : i + 500])
        assert [len(p.encode()) for p in split(text)] == [len(p) for p, _ in own.pre_tokenize_str(text)]


def test_ascii_splits_alike():
    by_rule, plain = regex.compile(token_counts.PATTERN).findall, regex.compile(token_counts.ASCII).findall
    draw = random.Random(7)
    chars = [chr(c) for c in range(128)] + [" ", "'", "\n", "'s", "'re", "'ll", " '", "a", "1", "!", "\t "] * 6
    for _ in range(20_000):
        text = "".join(draw.choices(chars, k=draw.randrange(1, 16)))
        assert token_counts._SPLIT_ASCII(text) == by_rule(text) == plain(text)


def test_equals_the_library(spark, library, monkeypatch):
    draw = random.Random(3)
    bits = ["a", "the", "ing", " ", "  ", "\n", "\t", "'s", "'ll", "12", "é", "中", "\U0001f600", "<|endoftext|>", "!!",
            "\u0558", "\u0c5c", "\U00010940", "\x85", "\xa0", "\x1c", "\r\n", "\u3000", "\u200b", "Ω", "<|", "|>"]
    texts = [None, "", " ", "\n\n", " a", "a  ", "a" * 3000, "<|endoftext|>" * 3, " <|endoftext|> "]
    texts += ["".join(draw.choices(bits, k=draw.randrange(1, 50))) for _ in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (token_counts.PART_CHARS, 30):
        monkeypatch.setattr(token_counts, "PART_CHARS", limit)
        pieces = [p for t in texts if t for p in token_counts.parts(t)]
        assert "".join(pieces) == "".join(t for t in texts if t)
        found = {r.doc_id: (r.n_bytes, r.n_tokens) for r in count_tokens(docs, model_file(FILE).decode()).collect()}
        assert found == {i: expected(library, t) for i, t in enumerate(texts)}


def test_only_what_holds_an_unsettled_character_is_counted_as_a_text(spark, library):
    counting = token_counts.Counting(model_file(FILE).decode())
    units = counting.units("the cat\n\n\u05e9\u05dc\u05d5\u05dd, cat  \u05e2 <|endoftext|>s  x<|endoftext|> a ")
    assert units == ["the", " cat", "\n\n\u05e9\u05dc\u05d5\u05dd,", " cat", "  \u05e2", " <|endoftext|>s",
                     "  x<|endoftext|>", " a", " "]
    draw = random.Random(5)
    bits = ["\u05e9\u05dc", "\u0c24", "\U0001f9e0", "cat", "'s", " ", "  ", "\n", "\t", "\x1c", "\xa0", "\r\n", "<|endoftext|>",
            "<|", "1", "?", "\u3000", "\u0627"]
    for _ in range(4000):
        text = "".join(draw.choices(bits, k=draw.randrange(1, 25)))
        units = counting.units(text)
        assert "".join(units) == text
        assert sum(counting.lengths(units)) == expected(library, text)[1]
    docs = spark.createDataFrame([("\u05e9\u05dc\u05d5\u05dd cat " * 3,)], "text string")
    assert frequent_pre_tokens(docs, model_file(FILE).decode(), size=2) == [" cat", " \u05e9\u05dc\u05d5\u05dd"]


def test_a_full_cache_starts_again(library, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED_CHARS", 10)
    counting = token_counts.Counting(model_file(FILE).decode())
    for units in ({" cat", "\u05e9" * 40}, {" cat", " dog"}, {" cat"}):
        counting.learn(units)
        assert all(counting.known[u] == expected(library, u)[1] for u in units)
    assert "\u05e9" * 40 not in counting.known


def test_whole_documents_whatever_the_table_holds(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wanted = {r.doc_id: expected(library, r.text) for r in docs.collect()}
    for frequent in (0, 10, 32_768):
        rows = count_tokens(docs, model_file(FILE).decode(), frequent=frequent).collect()
        assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == wanted


def test_frequent_pre_tokens_are_those_of_all_rows(spark):
    docs = spark.createDataFrame([("b b b a",), ("a a a",), (None,)], "text string").repartition(3)
    assert frequent_pre_tokens(docs, model_file(FILE).decode(), size=2) == [" a", " b"]


def test_nulls_repeats_extra_columns_and_empty_tables(spark):
    docs = spark.createDataFrame(
        [(None, None, 1), (1, "same", 2), (1, "same", 2)], "doc_id long, text string, n_tokens int"
    )
    rows = count_tokens(docs, model_file(FILE).decode()).collect()
    assert sorted((r.doc_id is None, r.n_bytes, r.n_tokens) for r in rows) == [(False, 4, 1), (False, 4, 1), (True, 0, 0)]
    assert count_tokens(docs.limit(0), model_file(FILE).decode()).count() == 0
