"""Language identification by bit-sliced Bloom filters of character n-grams.

Each language has a Bloom filter of the n-grams typical of it. The filters lie side
by side: a slot holds one bit per language, so one look-up of an n-gram (the AND of
its slots) returns all languages that contain it. A text's hits per language, less
those that the filter's false positives explain, decide.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmeter.llm.common import chunks, schema_of

#: N-gram lengths, slots of the filters (a power of two) and slots of one n-gram.
GRAMS, SLOTS, PROBES = (2, 3, 4), 1 << 19, 4
#: Learning reads about so many documents of each language, picked by a hash of id and text.
SAMPLE = 2_000
#: An n-gram belongs to a language whose documents hold it at least so often as the
#: language with the highest share does, and at least one in a thousand of them.
TYPICAL, RARE = 0.3, 0.001
UNKNOWN = "und"


@dataclass(frozen=True)
class Filters:
    """languages in order; slots: a row per slot, a column per 64 languages."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray


@cache
def _letters() -> np.ndarray:
    """1 for letters, 2 for marks, which belong to a word but make none."""
    kinds = bytearray(0x110000)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        kinds[code] = 1 if kind == "L" else 2 if kind == "M" else 0
    return np.frombuffer(bytes(kinds), np.uint8)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash) of every n-gram of the texts' words, and which texts have letters."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer(("  " + "  ".join(lowered) + "  ").encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len(t) + 2 for t in lowered], np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    owner = np.concatenate([owner, np.full(len(codes) - len(owner), len(texts) - 1)])
    kinds = _letters()[codes]
    word = kinds > 0
    lettered = np.bincount(owner[kinds == 1], minlength=len(texts)) > 0
    keep = word.copy()
    keep[1:] |= word[:-1]
    keep[:-1] |= word[1:]
    codes, owner, word = np.where(word, codes, 32)[keep].astype(np.uint64), owner[keep], word[keep]
    owners, keys = [], []
    for n in GRAMS:
        if len(codes) < n:
            continue
        size = len(codes) - n + 1
        inner = np.ones(size, bool)
        for i in range(1, n - 1):
            inner &= word[i : i + size]
        if n == 2:
            inner &= word[:size] | word[1 : 1 + size]
        key = np.full(size, n, np.uint64)
        for i in range(n):
            key = (key ^ codes[i : i + size]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
        owners.append(owner[:size][inner])
        keys.append(key[inner])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), lettered
    return np.concatenate(owners), np.concatenate(keys), lettered


def positions(keys: np.ndarray) -> Iterator[np.ndarray]:
    step = (keys >> np.uint64(33)) | np.uint64(1)
    at = keys * np.uint64(0xBF58476D1CE4E5B9)
    at ^= at >> np.uint64(31)
    for _ in range(PROBES):
        yield (at & np.uint64(SLOTS - 1)).astype(np.int64)
        at = at + step


def drawn(rows: DataFrame, sample: int = SAMPLE) -> tuple[list[str], DataFrame]:
    """The languages of ``rows`` (key, text, lang) and about ``sample`` different rows of each, or all it has.

    Rows are drawn by a hash of key and text, so that texts without a key have places of their
    own; rows that repeat count once.
    """
    place = F.xxhash64("key", "text")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(place, 0.02).alias("different"))
    counts = {r.lang: r.n if r.n <= sample else min(r.n, r.different) for r in counts.collect()}
    languages = sorted(counts)
    if not languages:
        return languages, rows.select("lang", "text")
    share = F.create_map(*(F.lit(x) for name in languages for x in (name, min(1.0, sample / max(1, counts[name])))))
    draw = F.pmod(place, F.lit(1 << 30)) / float(1 << 30)
    return languages, rows.filter(draw < share[F.col("lang")]).dropDuplicates(["lang", "key", "text"]).select("lang", "text")


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Filters:
    """The filters of all languages in ``lang``; rows without text or language teach nothing.

    Of each language about ``sample`` different documents are read, or all it has. The driver gets
    a row per language and per filled slot, ``SLOTS`` at most for 64 languages.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.filter("text is not null and lang is not null")
    languages, picked = drawn(rows, sample)
    if not languages:
        return Filters([], np.zeros((SLOTS, 1), np.uint64), np.zeros(0))
    number = {name: i for i, name in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            of = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            owner, keys, _ = grams(batch.column(1).to_pylist())
            # Once per document, then once per language with the number of documents.
            order = np.lexsort((owner, keys))
            owner, keys = owner[order], keys[order]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
            pairs = np.stack([keys[fresh].view(np.int64), of[owner[fresh]]], 1)
            found, n = np.unique(pairs, axis=0, return_counts=True) if len(pairs) else (pairs, pairs[:, 0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[:, 0]), pa.array(found[:, 1].astype(np.int32)), pa.array(n.astype(np.int64))],
                names=["gram", "language", "n"],
            )
            size = np.bincount(of, minlength=len(languages))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(languages), pa.int64()), pa.array(np.arange(len(languages), dtype=np.int32)), pa.array(size.astype(np.int64))],
                names=["gram", "language", "n"],
            )

    counted = picked.mapInArrow(count, "gram long, language int, n long")
    counted = counted.groupBy("gram", "language").agg(F.sum("n").alias("n")).persist()
    read = {r.language: r.n for r in counted.filter("gram is null").collect()}
    sizes = F.create_map(*(F.lit(x) for i in range(len(languages)) for x in (i, float(max(1, read.get(i, 0))))))
    rated = counted.filter("gram is not null").withColumn("rate", F.col("n") / sizes[F.col("language")])
    typical = (
        rated.groupBy("gram")
        .agg(F.max("rate").alias("most"), F.collect_list(F.struct("language", "rate")).alias("each"))
        .select("gram", "most", F.explode("each").alias("one"))
        .filter((F.col("one.rate") >= TYPICAL * F.col("most")) & (F.col("one.rate") >= RARE))
        .select("gram", F.col("one.language").alias("language"))
    )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            of = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = (np.uint64(1) << (of % 64).astype(np.uint64)).view(np.int64)
            for at in positions(keys):
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(of // 64), pa.array(bits)], names=["at", "part", "bits"])

    filled = typical.mapInArrow(fill, "at long, part long, bits long").groupBy("at", "part").agg(F.bit_or("bits").alias("bits"))
    slots = np.zeros((SLOTS, (len(languages) + 63) // 64), np.uint64)
    got = filled.toArrow()
    slots[got["at"].to_numpy(), got["part"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    counted.unpersist()
    filled_share = [np.mean((slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(languages))]
    return Filters(languages, slots, np.array(filled_share) ** PROBES)


def identify(
    docs: DataFrame, filters: Filters, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` of every row's whole text, and the columns ``carry``.

    ``lang_pred`` is the language with the highest share of the text's n-grams in its
    filter, false positives taken off; the first by name among equals. ``score`` is
    that share, 0 to 1. A null text or one without a letter is ``und`` with score 0, as
    is every text if no language was learnt. Repeated rows get the same answer. A carried
    ``text`` goes to the tasks and back once, not a second time beside itself.
    """
    beside, texts_too = [c for c in carry if c != text], text in carry
    names, words = filters.languages, filters.slots.shape[1]
    narrow = filters.slots.astype(np.uint8) if len(names) <= 8 else filters.slots
    sent = docs.sparkSession.sparkContext.broadcast((narrow, filters.false_rate))
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, false_rate = sent.value
        for batch in chunks(batches):
            n = batch.num_rows
            texts = [t or "" for t in batch.column(1).to_pylist()]
            owner, keys, lettered = grams(texts)
            masks = None
            for at in positions(keys):
                masks = slots[at] if masks is None else masks & slots[at]
            total = np.maximum(1, np.bincount(owner, minlength=n))
            hits = np.zeros((n, words * 64))
            for part in range((len(names) + 7) // 8):
                column = masks[:, part // 8]
                byte = column if column.dtype == np.uint8 else (column >> np.uint64(8 * (part % 8))) & np.uint64(255)
                table = np.bincount(owner * 256 + byte.astype(np.int64), minlength=n * 256).reshape(n, 256)
                hits[:, part * 8 : part * 8 + 8] = table @ bits
            if names:
                shares = (hits[:, : len(names)] / total[:, None] - false_rate) / (1 - np.minimum(false_rate, 0.999))
                best = shares.argmax(1)
                score = np.where(lettered, np.clip(shares[np.arange(n), best], 0, 1), 0.0)
                found = [names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered, strict=True)]
            else:
                found, score = [UNKNOWN] * n, np.zeros(n)
            out = [batch.column(0), pa.array(found, pa.string()), pa.array(score), batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*out, *([batch.column(1)] if texts_too else [])],
                names=["key", "lang_pred", "score", "carry", *(["text"] if texts_too else [])],
            )

    carried = F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(beside)))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), carried.alias("carry"))
    last = ("carry", "text") if texts_too else ("carry",)
    found = rows.mapInArrow(run, schema_of(rows, "key", "lang_pred string, score double", *last))
    places = {text: "text", **{c: f"carry.c{i}" for i, c in enumerate(beside)}}
    return found.select(F.col("key").alias(key), "lang_pred", "score", *(F.col(places[c]).alias(c) for c in carry))
