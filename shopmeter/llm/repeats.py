"""Repeated passages: bytes covered by strings of a given length that start twice or more.

1. Anchors. Of every window of ``length`` bytes the first one with the least hash of its
   ``ANCHOR``-byte strings is its anchor. Equal windows have equal anchors at equal
   places.
2. Contexts. The windows of an anchor are its context. Where anchor and context both occur
   again, the whole context is repeated; where the anchor occurs once, nothing is.
3. Intervals. The other contexts of an anchor, each different one once, are joined with
   those of other anchors to blocks of bounded size. On a block's Burrows-Wheeler
   transform, intervals of equal strings are extended backwards breadth first, one byte
   a round: a round derives where the common prefix has the next greater value. Intervals
   of one row are dropped, and at ``length`` bytes what is left is repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmeter.llm.common import CHUNK_BYTES, chunks, schema_of
from shopmeter.llm.words import _BASE, _BYTE, _INVERSE, flat_bytes, mix, powers
from shopmeter.session import durable

LENGTH, ANCHOR = 200, 64
#: Bytes of a text whose anchors are sought at once; longer texts go in overlapping parts.
PART = 2_000_000
#: Bytes of a block, and the contexts of one anchor that may enter it. The windows of an
#: anchor with more different contexts are compared by their digests instead.
BLOCK, CONTEXTS = 1_000_000, 2_048


def _sliding(values: np.ndarray, width: int, pick: np.ufunc, worst: int) -> np.ndarray:
    """``pick`` over values[i : i + width] for every i, shorter at the end."""
    n = len(values)
    padded = np.full(-(-(n + width) // width) * width, worst, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(
    raw: np.ndarray, low: np.ndarray, high: np.ndarray, first: int, stop: int, length: int = LENGTH, anchor: int = ANCHOR
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, context hash, first window's start, last one's) in bytes of texts in a row.

    ``low`` and ``high`` say for every byte where its text begins and ends; only windows
    that start from ``first`` to ``stop`` count.
    """
    reach, strings = length - anchor, len(raw) - anchor + 1
    none = np.zeros(0, np.int64)
    if len(raw) < length:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * powers(len(raw), _BASE), dtype=np.uint64)])
    inverse = powers(len(raw), _INVERSE)
    hashes = mix((sums[anchor:] - sums[:strings]) * inverse[:strings])
    least = _sliding(hashes, reach + 1, np.minimum, np.iinfo(np.uint64).max)
    starts = np.flatnonzero((np.arange(strings) + length <= high[:strings]) & (np.arange(strings) < stop))
    starts = starts[starts >= first]
    # Where a window's least hash is found: the place only moves on from window to window.
    wanted = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (wanted[1:] != wanted[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    runs = np.diff(np.append(heads, len(starts)))
    # All places with a run's hash between its first window's start and its last one's end;
    # more than one if strings repeat nearby.
    at, mark, begin, end = [], [], [], []
    sizes = runs + reach
    step = max(1, 1_000_000 // max(1, int(sizes.max(initial=1))))
    for part in range(0, len(heads), step):
        head, run = starts[heads[part : part + step]], runs[part : part + step]
        span = run + reach
        of = np.repeat(np.arange(len(head)), span)
        place = np.repeat(head, span) + np.arange(len(of)) - np.repeat(np.cumsum(span) - span, span)
        same = np.flatnonzero(hashes[np.minimum(place, strings - 1)] == wanted[heads[part : part + step]][of])
        of, place = of[same], place[same]
        # The windows of a place start after the place before it with the same hash.
        before = np.full(len(place), -1)
        before[1:] = np.where(of[1:] == of[:-1], place[:-1], -1)
        low_ = np.maximum(np.maximum(head[of], before + 1), place - reach)
        high_ = np.minimum(head[of] + run[of] - 1, place)
        some = low_ <= high_
        at.append(place[some])
        begin.append(low_[some])
        end.append(high_[some])
    at, begin, end = (np.concatenate(x) if x else none for x in (at, begin, end))
    # Runs of one place that another text or part broke apart are one anchor's.
    at, once, back = np.unique(at, return_index=True, return_inverse=True)
    if len(back) != len(at):
        low_, high_ = np.full(len(at), np.iinfo(np.int64).max), np.full(len(at), -1)
        np.minimum.at(low_, back, begin)
        np.maximum.at(high_, back, end)
        begin, end = low_, high_
    else:
        begin, end = begin[once], end[once]
    right = end + length
    context = (sums[right] - sums[begin]) * inverse[begin]
    shape = (at - begin).astype(np.uint64) * np.uint64(1 << 20) + (right - begin).astype(np.uint64)
    return at, hashes[at], mix(context ^ mix(shape + np.uint64(1))), begin, end


def text_anchors(texts: pa.Array, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text number, place, hash, context hash, first and last window's start) of all anchors."""
    raw, ends = flat_bytes(texts)
    sizes = np.diff(np.concatenate([[0], ends]))
    if len(raw) <= PART:
        of = np.repeat(np.arange(len(ends)), sizes)
        low, high = (ends - sizes)[of], ends[of]
        at, marks, contexts, begin, end = anchors(raw, low, high, 0, len(raw), length)
        of, base = of[at], low[at]
        return of, at - base, marks, contexts, begin - base, end - base
    found = []
    reach = length - ANCHOR
    for i, (size, stop_) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True)):
        text, parts = raw[stop_ - size : stop_], []
        for first in range(0, max(1, size - length + 1), PART):
            start, stop = max(0, first - reach), min(size, first + PART + length + reach)
            edge = np.full(stop - start, 0)
            at, marks, contexts, begin, end = anchors(
                text[start:stop], edge - start, edge + size - start, first - start, first - start + PART, length
            )
            parts.append((at + start, marks, contexts, begin + start, end + start))
        at, marks, contexts, begin, end = (np.concatenate(x) for x in zip(*parts, strict=True))
        # An anchor of windows of two parts has two contexts, told apart by their windows.
        found.append((np.full(len(at), i), at, marks, contexts, begin, end))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    """id, th, place, anchor, context.

    ``place`` holds where the first window starts and how many bytes all windows cover.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 2):
            of, _, marks, contexts, begin, end = text_anchors(batch.column(2), length)
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(of), batch.column(1).take(of), pa.array(begin << 32 | (end - begin + length)),
                 pa.array(marks.view(np.int64)), pa.array(contexts.view(np.int64))],
                names=["id", "th", "place", "anchor", "context"],
            )

    return rows.select("id", "th", "text").mapInArrow(run, "id long, th long, place long, anchor long, context long")


def suffix_order(symbols: np.ndarray, last: np.ndarray, depth: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Suffixes of strings in the order of their first ``depth`` symbols, and their ranks by
    the first few, twice as many and so on.

    ``symbols`` are small numbers from 1, with a 0 after every string; ``last`` is where a
    symbol's string has its 0. Suffixes that agree in ``depth`` symbols are in any order.
    """
    n, here = len(symbols), np.arange(len(symbols))
    bits = int(symbols.max(initial=1)).bit_length()
    known = min(63 // bits, depth)
    key = np.zeros(n, np.int64)
    for i in range(known):
        place = here + i
        key = key << bits | np.where(place <= last, symbols[np.minimum(place, n - 1)], 0)
    ranks = {}
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        fresh = np.ones(n, bool)
        fresh[1:] = sorted_[1:] != sorted_[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        ranks[known] = rank
        if known >= depth or fresh.all():
            return order, ranks
        place = here + known
        key = rank << 32 | np.where(place <= last, rank[np.minimum(place, n - 1)], 0)
        known *= 2


def repeated_starts(strings: list[bytes], length: int, begin: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(string number, offset) rows in groups of equal ``length``-byte strings.

    Returns places in the joined strings, grouped, and where each group starts. Intervals
    start with common prefixes of ``begin`` symbols or fewer, as sorting has found them.
    """
    flat = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    used = np.zeros(256, np.int64)
    used[np.unique(flat)] = 1
    code = np.cumsum(used) * used
    symbols = np.zeros(len(flat) + len(strings), np.int64)
    symbols[np.arange(len(flat)) + np.repeat(np.arange(len(strings)), sizes)] = code[flat]
    last = np.repeat(ends, sizes + 1)
    order, ranks = suffix_order(symbols, last, length)
    n = len(symbols)
    # The transform: the row of the suffix that begins with the symbol before each suffix.
    row_of = np.empty(n, np.int32)
    row_of[order] = np.arange(n, dtype=np.int32)
    previous = np.where(order > 0, row_of[order - 1], -1).astype(np.int32)
    previous[(order == 0) | (symbols[order - 1] == 0)] = -1
    initial = symbols[order].astype(np.int16)
    value = max((k for k in ranks if k < min(begin or length, length)), default=0)
    group, value = (ranks[value][order], value) if value else (initial, 1)
    # Rows whose string can still grow backwards to ``length`` symbols, none an end sign.
    into = order - (last - np.repeat(sizes, sizes + 1))[order]
    room = last[order] - order
    rows = np.flatnonzero((room >= value) & (into >= length - value)).astype(np.int32)
    parent = group[rows]
    owner = np.full(n, -1, np.int32)
    while True:
        edge = np.ones(len(rows), bool)
        edge[1:] = (parent[1:] != parent[:-1]) | (initial[rows[1:]] != initial[rows[:-1]])
        alone = edge & np.append(edge[1:], True)
        rows, edge = rows[~alone], edge[~alone]
        if value >= length or not len(rows):
            break
        # Backwards by one symbol: rows of one interval with the same symbol before them
        # are an interval again, and lie side by side.
        number = np.cumsum(edge).astype(np.int32)
        target = previous[rows]
        there = target >= 0
        owner[target[there]] = number[there]
        rows = np.flatnonzero(owner >= 0).astype(np.int32)
        parent = owner[rows]
        owner[rows] = -1
        value += 1
    return order[rows], np.flatnonzero(edge) if len(rows) else np.zeros(0, np.int64)


def _merge(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals that overlap or touch."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    fresh = np.ones(len(starts), bool)
    fresh[1:] = starts[1:] > stops[:-1]
    first = np.flatnonzero(fresh)
    return starts[first], stops[np.append(first[1:], len(starts)) - 1]


def _whole_characters(raw: bytes, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs without the bytes of characters that lie in them only in part."""
    starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    starts = np.append(starts, len(raw))
    low = starts[np.searchsorted(starts, low, side="left")]
    high = starts[np.searchsorted(starts, high, side="right") - 1]
    return low[low < high], high[low < high]


_SPANS = "id long, th long, low long, high long"


def _block_spans(block: dict[str, list], length: int) -> pa.RecordBatch:
    """The repeated runs inside a block's contexts that occur once."""
    strings = block["bytes"]
    places, groups = repeated_starts(strings, length)
    sizes = np.array([len(s) for s in strings], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    string = np.searchsorted(begins, places, side="right") - 1
    offset = places - begins[string] + np.array(block["low"], np.int64)[string]
    if len(groups):
        # One place of the corpus can lie in several contexts: a group needs two places.
        _, doc = np.unique(np.array([block["id"], block["th"]], np.int64), axis=1, return_inverse=True)
        corpus = doc.ravel()[string] << 32 | offset
        differ = np.minimum.reduceat(corpus, groups) != np.maximum.reduceat(corpus, groups)
        hit = np.repeat(differ, np.diff(np.append(groups, len(places)))) & np.array(block["once"], bool)[string]
        string, offset = string[hit], offset[hit]
    order = np.lexsort((offset, string))
    string, offset = string[order], offset[order]
    fresh = np.ones(len(string), bool)
    fresh[1:] = (string[1:] != string[:-1]) | (offset[1:] > offset[:-1] + length)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(string))[: len(first)] - 1
    own = string[first]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array(block["id"], np.int64)[own]), pa.array(np.array(block["th"], np.int64)[own]),
         pa.array(offset[first]), pa.array(offset[last] + length)],
        names=["id", "th", "low", "high"],
    )


def repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, contexts: int = CONTEXTS,
    characters: bool = False, carry: tuple[str, ...] = (),
) -> DataFrame:
    """``key``, ``n_bytes``, ``spans`` (array of (low, high) bytes), ``kept`` (binary) and ``carry``.

    Every byte is covered that lies in a ``length``-byte string of the texts' UTF-8 which
    also starts anywhere else, in the same text or another, overlaps included; ``spans``
    are the maximal runs of such bytes, ``kept`` is all others joined. A null text counts
    as empty; texts shorter than ``length`` keep everything. Rows with a null key and
    repeated rows are texts like all others, so a repeated row of ``length`` bytes or more
    loses all of them. With ``characters`` the runs shrink to whole characters, so that
    ``kept`` is a text again. ``carry`` names columns to return as they are.
    """
    reach = length - ANCHOR
    if reach < 0:
        raise ValueError(f"length must be {ANCHOR} at least")
    filled = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("id"),
        F.xxhash64(filled).alias("th"),
        filled.alias("text"),
        F.struct(F.lit(0).alias("none"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry))).alias("carry"),
    )
    found = _anchor_rows(rows, length)
    often = found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    # Written first: a join of two plain shuffles can split an anchor that many rows have.
    again = durable(found.join(durable(often), "anchor"))
    begin = F.shiftright("place", 32)
    low, high = begin.alias("low"), (begin + F.col("place").bitwiseAND(0xFFFFFFFF)).alias("high")

    # Every different context of an anchor, once, with one of its places.
    kinds = again.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "place")).alias("at"))
    kinds = durable(kinds.select("anchor", "context", "n", "at.id", "at.th", "at.place"))
    whole = again.join(kinds.filter("n > 1").select("anchor", "context"), ["anchor", "context"]).select("id", "th", low, high)
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    differing = kinds.join(several, "anchor").select(
        "id", "th", F.struct("anchor", "place", (F.col("n") == 1).alias("once"), (F.col("kinds") > contexts).alias("wide")).alias("w")
    )

    # The texts are dealt by their row once, for cutting the contexts out and for the end.
    dealt = rows.repartition("id", "th")
    wanted = differing.groupBy("id", "th").agg(F.collect_list("w").alias("wanted"))
    # All columns, so that both uses share one shuffle.
    cut = dealt.join(wanted, ["id", "th"]).select(*rows.columns, "wanted")

    def contexts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds_ = {"anchor": pa.int64(), "id": pa.int64(), "th": pa.int64(), "low": pa.int64(),
                  "once": pa.bool_(), "wide": pa.bool_(), "bytes": pa.binary()}
        for batch in chunks(batches, batch_text):
            out: dict[str, list] = {n: [] for n in kinds_}
            for i in range(batch.num_rows):
                wanted = batch.column("wanted")[i].values
                place = wanted.field("place").to_numpy(zero_copy_only=False)
                lows = (place >> 32).tolist()
                highs = ((place >> 32) + (place & 0xFFFFFFFF)).tolist()
                raw = batch.column(batch_text)[i].as_buffer().to_pybytes()
                out["low"] += lows
                out["bytes"] += [raw[a:b] for a, b in zip(lows, highs, strict=True)]
                for n in ("anchor", "once", "wide"):
                    out[n] += wanted.field(n).to_pylist()
                for n in ("id", "th"):
                    out[n] += [batch.column(n)[i].as_py()] * len(lows)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in kinds_.items()], names=list(kinds_))

    batch_text = rows.columns.index("text")
    texts = cut.mapInArrow(contexts_of, "anchor long, id long, th long, low long, once boolean, wide boolean, bytes binary")

    def by_transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("anchor", "id", "th", "low", "once", "bytes")
        block: dict[str, list] = {n: [] for n in names}
        size_, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if row[0] != last and size_ >= BLOCK:
                    yield _block_spans(block, length)
                    block, size_ = {n: [] for n in names}, 0
                last = row[0]
                for n, value in zip(names, row, strict=True):
                    block[n].append(value)
                size_ += len(row[-1])
        if size_:
            yield _block_spans(block, length)

    grouped = texts.filter("not wide").drop("wide").repartition("anchor").sortWithinPartitions("anchor", "id", "th", "low")
    narrow = grouped.mapInArrow(by_transform, _SPANS)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 4, CHUNK_BYTES // 16):
            parts = []
            for i, (id_, th, low_, once, raw) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                raw = np.frombuffer(raw, np.uint8)
                n = len(raw) - length + 1
                pair = []
                for base, inverse, table in ((_BASE, _INVERSE, _BYTE), (_INVERSE, _BASE, _BYTE[::-1])):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[raw] * powers(len(raw), base), dtype=np.uint64)])
                    pair.append(mix((sums[length:] - sums[:n]) * powers(n, inverse)).view(np.int64))
                parts.append((np.full(n, id_), np.full(n, th), low_ + np.arange(n), np.full(n, once), *pair))
            if parts:
                columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "th", "low", "once", "a", "b"])

    windows = texts.filter("wide").select("id", "th", "low", "once", "bytes")
    windows = windows.mapInArrow(digests, "id long, th long, low long, once boolean, a long, b long")
    where = F.struct("id", "th", "low")
    twice = windows.groupBy("a", "b").agg(F.min(where).alias("x"), F.max(where).alias("y")).filter("x <> y").select("a", "b")
    wide = windows.filter("once").join(twice, ["a", "b"]).select("id", "th", "low", (F.col("low") + length).alias("high"))

    spans = whole.unionByName(narrow).unionByName(wide)
    # Runs are merged where they meet, text by text; first inside each task.
    packed = spans.groupBy("id", "th").agg(F.collect_set(F.shiftleft("low", 32).bitwiseOR(F.col("high"))).alias("spans"))

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
        for batch in chunks(batches, 1):
            sizes, runs, kept = [], [], []
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_buffer().to_pybytes() if batch.column(1)[i].is_valid else b""
                own = batch.column(2)[i]
                sizes.append(len(raw))
                if not own.is_valid:
                    runs.append([])
                    kept.append(raw)
                    continue
                values = own.values.to_numpy(zero_copy_only=False)
                low_, high_ = _merge(values >> 32, values & 0xFFFFFFFF)
                if characters:
                    low_, high_ = _whole_characters(raw, low_, high_)
                runs.append([{"low": a, "high": b} for a, b in zip(low_.tolist(), high_.tolist(), strict=True)])
                edges = [0, *np.column_stack([low_, high_]).ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary()), batch.column(3)],
                names=["key", "n_bytes", "spans", "kept", "carry"],
            )

    joined = dealt.join(packed, ["id", "th"], "left").select("key", "text", "spans", "carry")
    added = "n_bytes long, spans array<struct<low:bigint,high:bigint>>, kept binary"
    cleared = joined.mapInArrow(clear, schema_of(joined, "key", added, "carry"))
    return cleared.select(
        F.col("key").alias(key), "n_bytes", "spans", "kept", *(F.col(f"carry.c{i}").alias(c) for i, c in enumerate(carry))
    )
