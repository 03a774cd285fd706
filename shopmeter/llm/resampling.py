"""Importance resampling to a target corpus, with an exact cutoff and no global sort.

Words and word pairs fall into hashed buckets. A bucket's gain is the logarithm of how much
commoner it is in the target; a document's weight is the mean gain of its features, looked
up in one array. A Gumbel number drawn from the key turns weights into scores, and the
highest scores are a weighted sample without replacement.

The last score drawn is found by a weighted median of medians: every partition names the
median of its rows still in question, the median of these weighted by the partitions' sizes
is the pivot, and at least a quarter of the rows lies on either side of it. Rows on the wrong
side go, until the pivot is the cutoff itself. Only what is drawn is sorted then.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmeter.llm.checksums import crc32_joined, crc32_with_byte, crc32_words
from shopmeter.llm.common import chunks, schema_of
from shopmeter.llm.words import flat_bytes
from shopmeter.session import durable

#: Buckets of features, and the words a document needs to be drawn.
BUCKETS, LEAST_WORDS = 10_000, 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Digits, lower-case letters and all beyond ASCII make up words.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def features(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text number and bucket of every word and pair of neighbouring words)."""
    raw, ends = flat_bytes(texts)
    count = len(ends)
    # A blank after every text keeps words of neighbouring texts apart.
    owner = np.repeat(np.arange(count), np.diff(np.concatenate([[0], ends])))
    spaced = np.full(len(raw) + count, 0x20, np.uint8)
    spaced[np.arange(len(raw)) + owner] = _LOWER[raw]
    edge = np.diff(np.concatenate([[False], _INSIDE[spaced]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    of = np.searchsorted(ends + np.arange(count), starts, side="left")
    single = crc32_words(spaced, starts, stops - starts)
    paired = np.flatnonzero(of[1:] == of[:-1])
    double = crc32_joined(crc32_with_byte(single[paired], 0x20), single[paired + 1], (stops - starts)[paired + 1])
    words = np.bincount(of, minlength=count)
    return words, np.concatenate([of, of[paired]]), np.concatenate([single, double]).astype(np.int64) % buckets


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: one array a task, added up before they reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in chunks(batches, text=0):
            total += np.bincount(features(batch.column(0), buckets)[2], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    counted = docs.select(F.col(text)).mapInArrow(run, "bucket long, n long")
    found = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's share in the target to that in the corpus."""
    buckets, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((float(t) + 1) * (float(s_all) + buckets) / ((float(s) + 1) * (float(t_all) + buckets))))
            for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
        ],
        np.int64,
    )


def gumbel(key: str = "doc_id", seed: int = 7) -> Column:
    """Thousandths of a Gumbel number drawn from the key; a null key counts as an empty one."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def score(
    docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    buckets: int = BUCKETS, seed: int = 7, carry: tuple[str, ...] = (),
) -> DataFrame:
    """``key, words, n_features, weight, score`` of every row, then the columns of ``carry``.

    Words are runs of ASCII letters and digits (A-Z as a-z) and of any characters beyond
    ASCII; features are words and pairs of neighbours, counted as often as they occur, over
    all rows of both tables. A text without words has weight 0, and so has a null one.
    """
    names = [key, "words", "n_features", "weight", "score", *carry]
    if len(set(names)) < len(names):
        raise ValueError(f"column names repeat: {names}")
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, target_text, buckets))
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("key"),
        F.col(f"`{text}`").alias("text"),
        F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry))).alias("row"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            words, of, bucket = features(batch.column(1), buckets)
            n = np.bincount(of, minlength=len(words))
            order = np.argsort(of, kind="stable")
            run_sum = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
            ends = np.cumsum(n)
            total = run_sum[ends] - run_sum[ends - n]
            weight = total // np.maximum(n, 1)
            out = [batch.column(0), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight), batch.column(2)]
            yield pa.RecordBatch.from_arrays(out, names=["key", "words", "n_features", "weight", "row"])

    scored = rows.mapInArrow(run, schema_of(rows, "key", "words long, n_features long, weight long", "row"))
    return scored.select(
        F.col("key").alias(key), "words", "n_features", "weight", (F.col("weight") + gumbel("key", seed)).alias("score"),
        *(F.col(f"row.c{i}").alias(c) for i, c in enumerate(carry)),
    )


def _place(key: str) -> list[Column]:
    """The order of the draw as ascending whole numbers; null keys come after the others."""
    return [
        (-F.col("score")).alias("o1"),
        F.col(f"`{key}`").isNull().cast("long").alias("o2"),
        F.coalesce(F.col(f"`{key}`"), F.lit(0)).cast("long").alias("o3"),
        F.col("n_features").cast("long").alias("o4"),
    ]


_ORDER = ["o1", "o2", "o3", "o4"]
Place = tuple[int, ...]


def _medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's number of rows and its (lower) median."""
    parts = [np.stack([b.column(c).to_numpy() for c in range(len(_ORDER))]) for b in batches if b.num_rows]
    if parts:
        rows = np.concatenate(parts, axis=1)
        size = rows.shape[1]
        middle = rows[:, np.lexsort(rows[::-1])[(size - 1) // 2]]
        yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in (size, *middle)], names=["size", *_ORDER])


def _at(place: Place) -> Column:
    return F.struct(*(F.lit(v).cast("long").alias(name) for v, name in zip(place, _ORDER, strict=True)))


def cutoff(places: DataFrame, wanted: int) -> Place:
    """The ``wanted``-th (from 1) of the rows ``o1, o2, o3, o4`` in ascending order.

    Every round asks for a median of each partition and one count; the driver sees a row per
    partition. The rows still in question are written anew when a quarter is left, so all
    rounds together read a small multiple of the table.
    """
    place, left = F.struct(*_ORDER), places
    stored, before = None, 0
    while True:
        asked: list[Any] = left.mapInArrow(_medians, "size long, " + ", ".join(f"{c} long" for c in _ORDER)).collect()
        size = sum(r[0] for r in asked)
        if stored is None:
            stored = size
        reached = 0
        for row in sorted(asked, key=lambda r: r[1:]):
            reached += row[0]
            if 2 * reached >= size:
                pivot = tuple(row[1:])
                break
        counted = left.agg(F.count_if(place < _at(pivot)).alias("less"), F.count_if(place == _at(pivot)).alias("same")).first()
        if wanted <= before + counted.less:
            left, size = left.filter(place < _at(pivot)), counted.less
        elif wanted <= before + counted.less + counted.same:
            return pivot
        else:
            before += counted.less + counted.same
            left, size = left.filter(place > _at(pivot)), size - counted.less - counted.same
        if 4 * size <= stored:
            left, stored = durable(left), size


def draw(scored: DataFrame, share: int, key: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... for the rows drawn, null for the others.

    Of the N rows with at least ``least_words`` words, floor(share * N / 100) are drawn, highest
    scores first; ties go to the smaller key (null keys last), then to fewer features. Of rows
    equal in all of these, which give the same figures, any are drawn, repeated or not.
    """
    if clash := {"rank", "_salt", "_part", "_offset", *_ORDER} & set(scored.columns):
        raise ValueError(f"columns have reserved names: {sorted(clash)}")
    kept, columns = durable(scored), [f"`{c}`" for c in scored.columns]
    open_ = F.col("words") >= least_words
    wanted = share * kept.filter(open_).count() // 100
    if not wanted:
        return kept.withColumn("rank", F.lit(None).cast("long"))
    last = cutoff(kept.filter(open_).select(*_place(key)), wanted)
    placed = kept.select("*", *_place(key))
    in_question = open_ & (F.struct(*_ORDER) <= _at(last))
    # The salt lets a range hold a part of many equal rows; written, so that ranges stay as they are.
    chosen = placed.filter(in_question).withColumn("_salt", F.monotonically_increasing_id())
    chosen = chosen.repartitionByRange(*_ORDER, "_salt").sortWithinPartitions(*_ORDER, "_salt")
    chosen = durable(chosen.select(*columns))
    offsets, total = [], 0
    sizes = chosen.groupBy(F.spark_partition_id().alias("_part")).agg(F.count("*").alias("n")).collect()
    for part, n in sorted((r[0], r[1]) for r in sizes):
        offsets.append((part, total))
        total += n
    before = kept.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    index = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    ranked = chosen.withColumns({"_part": F.spark_partition_id(), "rank": index}).join(F.broadcast(before), "_part")
    rank = F.col("rank") + F.col("_offset") + 1
    ranked = ranked.select(*columns, F.when(rank <= wanted, rank).alias("rank"))
    others = placed.filter(~F.coalesce(in_question, F.lit(False))).select(*columns)
    return ranked.unionByName(others.withColumn("rank", F.lit(None).cast("long")))
