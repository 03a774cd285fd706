"""Document fingerprints: one-permutation MinHash with optimal densification, packed.

Every shingle is hashed once; the hash's place says which bin it falls in, and a bin
keeps its least value. An empty bin borrows from the bin that a hash of (bin, attempt)
names, trying on until that bin is full, so two texts borrow alike. A fingerprint is
the lowest bits of all bins, in hexadecimal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopmeter.llm.common import chunks
from shopmeter.llm.words import mix, shingles

SHINGLE, BINS, BITS = 5, 256, 4


def fingerprints(texts: pa.Array, shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> list[str]:
    """A fingerprint per text. Texts without a word share that of the empty set.

    The empty set's fingerprint is the word ``empty``; it is like itself and like no other.
    """
    of, hashes = shingles(texts, shingle)
    n = len(texts)
    table = np.full((n, bins), np.iinfo(np.uint64).max, np.uint64)
    bin_of = (hashes >> np.uint64(32)) % np.uint64(bins)
    value = mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    cell = of * bins + bin_of.astype(np.int64)
    order = np.lexsort((value, cell))
    cell, value = cell[order], value[order]
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    full = np.zeros(n * bins, bool)
    flat = table.reshape(-1)
    flat[cell[first]], full[cell[first]] = value[first], True
    lent = flat.copy()
    some = np.repeat(full.reshape(n, bins).any(1), bins)
    empty, attempt = np.flatnonzero(~full & some), 0
    while len(empty):
        attempt += 1
        own = (empty % bins).astype(np.uint64)
        turn = np.uint64(attempt * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
        other = mix(own * np.uint64(0x9E3779B97F4A7C15) + turn)
        source = empty - empty % bins + (other % np.uint64(bins)).astype(np.int64)
        found = full[source]
        # Mixed with the borrower's number, so that one value lent often isn't one chance hit.
        lent[empty[found]] = mix(flat[source[found]] + own[found])
        empty = empty[~found]
    low = (lent.reshape(n, bins) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    spread = (low[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    packed = np.packbits(spread.reshape(n, bins * bits), axis=1)
    has = some.reshape(n, bins)[:, 0]
    return [row.tobytes().hex() if ok else "empty" for row, ok in zip(packed, has.tolist(), strict=True)]


def likeness(a: list[str], b: list[str], bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """The resemblance that pairs of fingerprints estimate, 0 to 1.

    Of unlike bins one in 2^bits agrees by chance; that share is taken off.
    """
    out = np.array([float(x == y) for x, y in zip(a, b, strict=True)])
    pairs = [i for i, (x, y) in enumerate(zip(a, b, strict=True)) if x != y and "empty" not in (x, y)]
    if pairs:
        left = np.frombuffer(bytes.fromhex("".join(a[i] for i in pairs)), np.uint8).reshape(len(pairs), -1)
        right = np.frombuffer(bytes.fromhex("".join(b[i] for i in pairs)), np.uint8).reshape(len(pairs), -1)
        differ = np.unpackbits(left ^ right, axis=1).reshape(len(pairs), bins, bits).any(2)
        chance = 2.0**-bits
        out[pairs] = np.clip((1 - differ.mean(1) - chance) / (1 - chance), 0, 1)
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as much of the following text's start."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


_SCHEMA = (
    "n_chars long, edited_text string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
#: Characters of a text that tell ranges apart, and rows looked at for each bound.
PREFIX, LOOKED_AT = 200, 20
#: Texts of about so many characters are fingerprinted at once.
CHUNK_CHARS = 1_000_000


def _compare(keys: list, texts: list[str], kind: pa.DataType, key: str, settings: dict) -> pa.RecordBatch:
    """Rows for all texts but the last, which is only the next of the one before it."""
    n = len(keys)
    changed = [edited(t, f) for t, f in zip(texts[:n], texts[1:], strict=True)]
    marks = fingerprints(pa.array(texts + changed, pa.large_string()), **settings)
    own, after, new = marks[:n], marks[1 : n + 1], marks[n + 1 :]
    shape = {k: v for k, v in settings.items() if k != "shingle"}
    same = np.array([t == c for t, c in zip(texts, changed, strict=False)])
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, kind), pa.array([len(t) for t in texts[:n]], pa.int64()), pa.array(changed, pa.string()),
         pa.array(own, pa.string()), pa.array(new, pa.string()),
         pa.array(np.where(same, 1.0, likeness(own, new, **shape))), pa.array(likeness(own, after, **shape))],
        names=[key, "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _range_of(rows: DataFrame, ranges: int) -> tuple[Column, int]:
    """The number of the range that a row's (key, beginning of the text) falls in, ascending, and how many there are.

    The bounds are picked once, by the driver, from a few rows for each; from then on a row's
    range is a plain function of its values, however often a plan computes it. Every range
    holds a row, the one that its lower bound was taken from, or the first one seen.
    """
    place = F.struct("key", F.substring("text", 1, PREFIX).alias("begin"))
    looked = rows.select(place.alias("p")).orderBy(F.rand(10)).limit(LOOKED_AT * ranges).orderBy("p")
    found = [(r.p.key, r.p.begin) for r in looked.collect()]
    picked = dict.fromkeys(found[i * len(found) // ranges] for i in range(1, ranges)) if found else {}
    bounds = [bound for bound in picked if bound != found[0]]
    if not bounds:
        return F.lit(0), 1
    kind = rows.schema["key"].dataType.simpleString()
    keys = F.array(*(F.lit(k).cast(kind) for k, _ in bounds))
    begins = F.array(*(F.lit(b) for _, b in bounds))

    def halve(at: Column, _: Column) -> Column:
        middle = F.shiftright(at["low"] + at["high"], 1)
        bound = F.struct(F.get(keys, middle).alias("key"), F.get(begins, middle).alias("begin"))
        beyond = bound <= place
        low = F.when((at["low"] < at["high"]) & beyond, middle + 1).otherwise(at["low"])
        high = F.when((at["low"] < at["high"]) & ~beyond, middle).otherwise(at["high"])
        return F.struct(low.alias("low"), high.alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, halve)["low"], len(bounds) + 1


def fingerprint_neighbours(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bins: int = BINS, bits: int = BITS
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how like they are.

    The edited text has its last quarter of characters replaced by the start of the next
    row's text, in ascending (key, text) order, the first row being next of the last.
    ``near_edited`` compares a text with its edited text, ``near_next`` with the next
    text; both 0 to 1. A null text counts as empty. Rows with a null key come first;
    repeated rows follow one another. Alone in its table, a row is its own next.

    The texts are dealt by ranges of key and text, so that rows of one key or none can lie in
    several, and sorted within each range; only a range's last row needs the first row of the
    next one. The texts are dealt out once and read twice.
    """
    settings = {"shingle": shingle, "bins": bins, "bits": bits}
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number, ranges = _range_of(rows, 2 * parts)
    numbered = rows.withColumn("range", number)
    dealt = numbered.repartition(parts, "range").sortWithinPartitions("range", "key", "text")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
        """Pieces of one range each, and whether a piece goes on with the one before it."""
        last = None
        for batch in batches:
            numbers = batch.column(2).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if high > low:
                    yield numbers[low] == last, batch.slice(low, high - low)
                    last = numbers[low]

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts = [], []
        for goes_on, batch in runs(chunks(batches, most=CHUNK_CHARS)):
            if not goes_on:
                keys, texts = [], []
            kind_ = batch.column(0).type
            keys += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
            if len(texts) > 1:
                yield _compare(keys[:-1], texts, kind_, key, settings)
                keys, texts = keys[-1:], texts[-1:]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ends(first: pa.RecordBatch, last: pa.RecordBatch) -> pa.RecordBatch:
            at = first.column(2)[0].as_py()
            keys = pa.concat_arrays([last.column(0), pa.nulls(1, last.column(0).type)])
            texts = pa.concat_arrays([last.column(1), first.column(1)])
            return pa.RecordBatch.from_arrays(
                [pa.array([(at + 1) % ranges, at], pa.int32()), pa.array([0, 1], pa.int32()), keys, texts],
                names=["seam", "side", "key", "text"],
            )

        first = last = None
        for goes_on, batch in runs(batches):
            if not goes_on:
                if first is not None:
                    yield ends(first, last)
                first = batch.slice(0, 1)
            last = batch.slice(batch.num_rows - 1, 1)
        if first is not None:
            yield ends(first, last)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            for seam, side, own, text_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if side == 0:
                    before = (seam, own, text_)
                elif before is None or before[0] != seam:
                    raise RuntimeError("the rows changed while they were read")
                else:
                    yield _compare([before[1]], [before[2], text_], batch.column(2).type, key, settings)

    schema = f"`{key}` {kind}, {_SCHEMA}"
    # A range's last text and the next one's first meet at the seam between the two.
    seams = dealt.mapInArrow(edges, f"seam int, side int, key {kind}, text string")
    seams = seams.repartition("seam").sortWithinPartitions("seam", "side")
    return dealt.mapInArrow(within, schema).unionByName(seams.mapInArrow(across, schema))
