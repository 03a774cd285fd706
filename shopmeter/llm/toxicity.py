"""Toxicity by compression distance: two zstandard dictionaries, window by window.

Both dictionaries begin with one trained on ordinary text. The toxic one ends with words
of toxic documents, picked for fragments that recur there and hardly anywhere else; the
ordinary one ends with as many blanks. So lengths differ by these words alone, and a
window that gets shorter with the toxic dictionary resembles toxic text. How many windows
must get how much shorter is calibrated on labelled documents that trained neither, and
so is how many of the words the list holds: all of them if that is not clearly worse.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmeter.llm.common import chunks
from shopmeter.llm.labelled import sample

#: Labelled documents of either class to learn from.
PER_CLASS = 3_000
#: Bytes of a window, to the next blank; a longer run without blanks is cut.
WINDOW, LONGEST = 48, 256
#: Size of the common beginning; the toxic end has as many bytes as its words, but so many at least.
COMMON_BYTES, LEAST_BYTES = 65_536, 1_024
#: Lists of all words, half of them and so on are tried while they have so many bytes.
SHORTEST_LIST = 100
#: Windows that one document lends to the common beginning, spread over its text.
LENT = 32
#: Toxic fragments have so many characters and are at least RATIO times as common in words
#: of toxic documents as of ordinary ones, and in LEAST_TOXIC of the toxic documents.
FRAGMENT, RATIO, LEAST_TOXIC = 5, 20, 2
#: Longer words, such as whole sentences without blanks, count as pieces of so many
#: characters that overlap by a fragment.
LONGEST_WORD = 24
#: A toxic document that is missed counts as so many ordinary ones that are not let through.
TOXIC_WEIGHT = 3
#: Windows are counted by whether they get shorter by 1, 2, ... or so many bytes.
GAINS = 6
FEATURES = GAINS + 3
#: A run without blanks from its first to its last character that is no ASCII sign.
_SIGNS = r"\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f"
_WORD = rf"[^\s{_SIGNS}](?:\S*[^\s{_SIGNS}])?"
#: The shortest match of the compressor.
_MATCH = 5


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]


def windows(text: str) -> list[bytes]:
    raw, out, start = text.lower().encode("utf-8", "replace"), [], 0
    while start < len(raw):
        stop = start + WINDOW
        if stop < len(raw):
            blank = raw.find(b" ", stop, start + LONGEST)
            stop = blank if blank >= 0 else min(len(raw), start + LONGEST)
        out.append(raw[start:stop])
        start = stop
    return out


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    # The same settings for both dictionaries.
    reach = max(18, (len(content) + LONGEST).bit_length())
    settings = zstandard.ZstdCompressionParameters(
        window_log=reach, chain_log=18, hash_log=18, search_log=1, min_match=_MATCH, target_length=16,
        strategy=zstandard.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    entries = zstandard.ZstdCompressionDict(content)
    entries.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=entries, compression_params=settings)


def trained(size: int, samples: list[bytes]) -> bytes:
    """A dictionary of the samples; too few to train on are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" ".join(dict.fromkeys(samples))[-size:]


def endings(words: list[str]) -> list[bytes]:
    """All words, the first half of their bytes, and so on; the first words last, where a dictionary is cheapest."""
    spelt = [word.encode() for word in words]
    ends, out = np.cumsum([len(word) for word in spelt]), []
    most = int(ends[-1]) if spelt else 0
    while not out or most >= SHORTEST_LIST:
        n = int(np.searchsorted(ends, most, side="right"))
        out.append(b"".join(reversed(spelt[:n])).rjust(LEAST_BYTES))
        most //= 2
    return out


def longest(xs: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> int:
    """The first of the features whose cross-validated loss is within one standard error of the least one.

    One is the usual margin, taken as it is; only rows that may be learnt from decide.
    """
    fold, means, errors = np.arange(len(y)) % 5, [], []
    for x in xs:
        loss = np.zeros(len(y))
        for k in range(5):
            w = np.array(calibrate(x[fold != k], y[fold != k], weight[fold != k]))
            z = x[fold == k] @ w[:-1] + w[-1]
            loss[fold == k] = np.logaddexp(0, np.where(y[fold == k] == 1, -z, z))
        mean = np.average(loss, weights=weight)
        means.append(mean)
        errors.append(np.sqrt(((weight * (loss - mean)) ** 2).sum()) / weight.sum())
    best = int(np.argmin(means))
    return next(i for i, mean in enumerate(means) if mean <= means[best] + errors[best])


class Distance:
    """Features of texts: how much their windows gain from the toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.compressors = _compressor(ordinary), _compressor(toxic)

    def features(self, texts: list[str]) -> np.ndarray:
        split = [windows(t) for t in texts]
        counts = np.array([len(one) for one in split], np.int64)
        out = np.zeros((len(texts), FEATURES))
        if counts.sum():
            flat = [w for one in split for w in one]
            gain = self._lengths(self.compressors[0], flat) - self._lengths(self.compressors[1], flat)
            of, n = np.repeat(np.arange(len(texts)), counts), np.maximum(1, counts)
            for least in range(1, GAINS + 1):
                out[:, least - 1] = np.log1p(np.bincount(of[gain >= least], minlength=len(texts)))
            out[:, GAINS] = 10 * np.bincount(of[gain >= 2], minlength=len(texts)) / n
            out[:, GAINS + 1] = np.log(n)
            out[:, GAINS + 2] = 5 * np.clip(np.bincount(of, np.maximum(gain, -1), len(texts)) / n, -2, 2)
        return out

    @staticmethod
    def _lengths(compressor: zstandard.ZstdCompressor, flat: list[bytes]) -> np.ndarray:
        done = compressor.multi_compress_to_buffer(flat, threads=0)
        return np.fromiter((len(done[i]) for i in range(len(done))), np.int64, len(done))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Logistic weights (the last is the intercept) by Newton's method, lightly regularised."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (weight * (p - y)) + 0.1 * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return tuple(w.tolist())


def vocabulary(learning: DataFrame, size: dict[int, int]) -> list[str]:
    """The commonest word of every toxic fragment with blanks around it, by how many toxic documents hold the fragment."""
    runs = F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))
    starts = lambda run: F.sequence(F.lit(1), F.length(run), F.lit(LONGEST_WORD - FRAGMENT + 1))
    cut = lambda run: F.transform(starts(run), lambda i: F.substring(run, i, LONGEST_WORD))
    pieces = F.flatten(F.transform(runs, lambda run: F.when(F.length(run) <= LONGEST_WORD, F.array(run)).otherwise(cut(run))))
    words = learning.select("label", F.explode(F.array_distinct(pieces)).alias("word"))
    words = words.filter(F.octet_length("word") >= _MATCH - 2).groupBy("word")
    words = words.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("ordinary"))
    spelt = F.concat(F.lit(" "), "word", F.lit(" "))
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(spelt) - (FRAGMENT - 1)))
    fragments = F.array_distinct(F.transform(places, lambda i: F.substring(spelt, i, FRAGMENT)))
    found = words.select("word", "toxic", "ordinary", F.explode(fragments).alias("fragment")).groupBy("fragment")
    found = found.agg(
        F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"), F.max(F.struct("toxic", "word")).alias("most")
    )
    rate = (F.col("ordinary") + 0.5) * RATIO * max(1, size.get(1, 0)) / max(1, size.get(0, 0))
    best = found.filter((F.col("toxic") >= LEAST_TOXIC) & (F.col("toxic") >= rate)).orderBy(F.desc("toxic"), "fragment")
    return list(dict.fromkeys(f" {r.word} " for r in best.select("most.word").collect()))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, key: str = "doc_id") -> Model:
    """Dictionaries and calibration from at most ``per_class`` documents of either class.

    Two thirds of them train the dictionaries, the others calibrate. Words are counted by
    Spark; the driver gets at most ``LENT`` windows of an ordinary document, a word for every
    toxic fragment of the sample and ``FEATURES`` numbers of a calibrating document and list.
    Without both classes every score is the share of toxic documents among the labelled ones
    (0 without any).
    """
    picked = sample(docs, labels, label, per_class, key)
    calibrating = F.pmod(F.xxhash64("key", F.lit(5)), F.lit(3)) == 0
    learning, checking = picked.filter(~calibrating), picked.filter(calibrating)
    n = {r.label: r.n for r in learning.groupBy("label").agg(F.count("*").alias("n")).collect()}

    def lend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 0):
            lent = []
            for text in batch.column(0).to_pylist():
                own = windows(text)
                lent += own[:: max(1, -(-len(own) // LENT))]
            yield pa.RecordBatch.from_arrays([pa.array(lent, pa.binary())], names=["window"])

    ordinary_text = learning.filter("label = 0").orderBy("draw", "key").select("text")
    lent = ordinary_text.mapInArrow(lend, "window binary").toArrow()["window"].to_pylist()
    common = trained(COMMON_BYTES, lent)
    tried = endings(vocabulary(learning, n))
    pairs = [(common + b" " * len(end), common + end) for end in tried]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = [Distance(*pair) for pair in pairs]
        for batch in chunks(batches, 0):
            values = np.hstack([distance.features(batch.column(0).to_pylist()) for distance in distances])
            yield pa.RecordBatch.from_arrays(
                [pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64())), batch.column(1), batch.column(2)],
                names=["x", "label", "weight"],
            )

    ordered = checking.select("text", "label", "weight", "draw", "key").orderBy("draw", "key").select("text", "label", "weight")
    seen = ordered.mapInArrow(measure, "x array<double>, label int, weight double").toArrow()
    y = seen["label"].to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        share = float(np.mean([*y, *([1.0] * n.get(1, 0)), *([0.0] * n.get(0, 0))] or [0.0]))
        odds = np.log(max(share, 1e-6) / max(1 - share, 1e-6))
        return Model(*pairs[0], (0.0,) * FEATURES + (float(odds),))
    weight = seen["weight"].to_numpy() * np.where(y == 1, TOXIC_WEIGHT, 1)
    weight = weight / weight.mean()
    xs = np.split(np.array(seen["x"].to_pylist()), len(pairs), axis=1)
    at = longest(xs, y, weight)
    return Model(*pairs[at], calibrate(xs[at], y, weight))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` (0 to 1, higher: more likely toxic) of every row's whole text.

    A null text counts as empty; it has no window and gets the intercept's score. Equal
    texts have equal scores; repeated rows and rows with a null key are scored each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # dictionaries of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance, weights = Distance(sent.value.ordinary, sent.value.toxic), np.array(sent.value.weights)
        for batch in chunks(batches):
            values = distance.features([t or "" for t in batch.column(1).to_pylist()])
            total = values @ weights[:-1] + weights[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=[key, "score"])

    rows = docs.select(F.col(key), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, score double")
