"""A quality classifier: logistic regression over hashed word n-grams, trained by FTRL.

Words are runs of letters and digits or of other signs. Features are hashed words, pairs
of words, and triples of word shapes, a shape being how a word is written and whether it
repeats one of the two before it. Weights are learnt by follow-the-regularised-leader
updates on a bounded sample; a score is a sparse dot product with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmeter.llm.common import chunks
from shopmeter.llm.labelled import sample
from shopmeter.llm.words import _BASE, _BYTE, _INVERSE, flat_bytes, mix, powers

#: Weights, labelled documents of either class to learn from, and passes over them.
BUCKETS, PER_CLASS, EPOCHS = 1 << 18, 4_000, 3
ALPHA, BETA, L1, L2 = 0.1, 1.0, 0.5, 1.0

_KIND = np.full(256, 1, np.int8)  # letters and digits, any byte of other scripts
_KIND[:0x80] = 2
for _low, _high in (("0", "9"), ("A", "Z"), ("a", "z")):
    _KIND[ord(_low) : ord(_high) + 1] = 1
_KIND[[*range(0x21)]] = 0
_UPPER = np.zeros(256, np.int64)
_UPPER[ord("A") : ord("Z") + 1] = 1
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[ord("A") : ord("Z") + 1] += 32


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every n-gram of the texts."""
    raw, ends = flat_bytes(texts)
    count = len(ends)
    owner = np.repeat(np.arange(count), np.diff(np.concatenate([[0], ends])))
    spaced = np.full(len(raw) + count, 0x20, np.uint8)
    spaced[np.arange(len(raw)) + owner] = raw
    kind = _KIND[spaced]
    edge = np.flatnonzero(np.diff(kind)) + 1
    edge = np.concatenate([[0], edge, [len(spaced)]]) if len(spaced) else np.zeros(1, np.int64)
    starts, stops = edge[:-1], edge[1:]
    real = kind[starts] > 0 if len(starts) else np.zeros(0, bool)
    starts, stops = starts[real], stops[real]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWERED[spaced]] * powers(len(spaced), _BASE), dtype=np.uint64)])
    words = mix((sums[stops] - sums[starts]) * powers(len(spaced) + 1, _INVERSE)[starts])
    of = np.searchsorted(ends + np.arange(count), starts, side="left")
    n = len(words)
    capitals = np.concatenate([[0], np.cumsum(_UPPER[spaced])])
    upper = capitals[stops] - capitals[starts]
    length = stops - starts
    shape = kind[starts].astype(np.uint64) * np.uint64(3)
    shape += np.where((upper == length) & (length > 1), 2, np.where(upper > 0, 1, 0)).astype(np.uint64)
    for lag, sign in ((1, 16), (2, 32)):
        same = np.zeros(n, bool)
        if n > lag:
            same[lag:] = (words[lag:] == words[:-lag]) & (of[lag:] == of[:-lag])
        shape += np.where(same, sign, 0).astype(np.uint64)
    shape += np.where(kind[starts] == 2, np.minimum(length, 4) * 64, 0).astype(np.uint64)
    owners, keys = [of], [words]
    if n > 1:
        inside = of[1:] == of[:-1]
        owners.append(of[1:][inside])
        keys.append(mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])[inside])
    if n > 2:
        inside = of[2:] == of[:-2]
        triple = (shape[:-2] * np.uint64(1 << 20) + shape[1:-1] * np.uint64(1 << 10) + shape[2:]) ^ np.uint64(0xD1B54A32D192ED03)
        owners.append(of[2:][inside])
        keys.append(mix(triple)[inside])
    return np.concatenate(owners), (np.concatenate(keys) & np.uint64(BUCKETS - 1)).astype(np.int64)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int, float]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and intercept from (buckets, values, label, weight) in the order given."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(i: np.ndarray) -> np.ndarray:
        held = np.where(i == BUCKETS, 0.0, L1)  # the intercept isn't held back
        w = np.sign(z[i]) * held - z[i]
        return np.where(np.abs(z[i]) <= held, 0.0, w / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for buckets, values, label, weight in examples:
            i, x = np.append(buckets, BUCKETS), np.append(values, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = weight * (p - label) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    all_ = weights(np.arange(BUCKETS + 1))
    return all_[:BUCKETS].astype(np.float32), float(all_[BUCKETS])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, key: str = "doc_id") -> tuple[np.ndarray, float]:
    """Weights and intercept learnt from at most ``per_class`` documents of either class.

    Updates follow one another, so one task makes them, over that bounded sample only.
    Without labelled documents every score is the same, 0.5.
    """
    picked = sample(docs, labels, label, per_class, key)
    ordered = picked.select("draw", "text", "label", "weight", "key").repartition(1).sortWithinPartitions("draw", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in chunks(batches):
            of, buckets = features(batch.column(1))
            size = np.maximum(1, np.bincount(of, minlength=batch.num_rows))
            cells, counts = np.unique(of * BUCKETS + buckets, return_counts=True)
            first = np.searchsorted(cells // BUCKETS, np.arange(batch.num_rows + 1))
            for i, (y, weight) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                part = slice(first[i], first[i + 1])
                values = (counts[part] / np.sqrt(size[i])).astype(np.float32)
                examples.append(((cells[part] % BUCKETS).astype(np.int32), values, y, weight))
        mean = np.mean([e[3] for e in examples]) if examples else 1.0
        weights, intercept = ftrl([(b, v, y, w / mean) for b, v, y, w in examples])
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1).astype(np.int64)), pa.array(np.append(weights[used], intercept).astype(np.float64))],
            names=["bucket", "weight"],
        )

    learnt = ordered.mapInArrow(run, "bucket long, weight double").toArrow()
    at, values = learnt["bucket"].to_numpy(), learnt["weight"].to_numpy()
    weights = np.zeros(BUCKETS, np.float32)
    weights[at[at >= 0]] = values[at >= 0]
    return weights, float(values[at < 0].sum())


def score(docs: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` (0 to 1) of every row's whole text.

    A null text counts as empty and gets the score of the intercept alone. Equal texts
    have equal scores; repeated rows and rows with a null key are scored each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, intercept = sent.value
        for batch in chunks(batches):
            of, buckets = features(batch.column(1))
            size = np.maximum(1, np.bincount(of, minlength=batch.num_rows))
            total = np.bincount(of, weights[buckets], minlength=batch.num_rows) / np.sqrt(size)
            value = 1 / (1 + np.exp(-np.clip(total + intercept, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], names=[key, "score"])

    rows = docs.select(F.col(key), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, score double")
