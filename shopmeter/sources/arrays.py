"""Large JSON arrays, read by many tasks.

A file is cut at closing braces, which Spark's text reader does at any split. Whether a brace
lies inside a string, and how deep, depends on all that comes before it; but what a split
changes about that can be told without knowing where it starts. So a first pass sums up
every split in a few numbers, from which the state at each split's start follows, and a second
pass cuts the objects out. What crosses the edge of a split is joined again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CUT, _QUOTE, _ESCAPE = ord("}"), ord('"'), ord("\\")
_SPACE = b" \t\r\n"
_BOM = b"\xef\xbb\xbf"


@dataclass(frozen=True)
class Start:
    """What holds where a split begins: inside a string or not, how deep, and the split's place."""

    inside: int
    depth: int
    first: bool
    last: bool
    open_end: bool  # the file's last piece is not followed by a closing brace


def _fragments(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, start, size, value``: the pieces between closing braces, in order within a split."""
    pieces = spark.read.option("lineSep", "}").text(path)
    meta = [F.col(f"_metadata.{m}") for m in ("file_path", "file_block_start", "file_size")]
    return pieces.select(meta[0].alias("file"), meta[1].alias("start"), meta[2].alias("size"), "value")


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, np.ndarray, int]]:
    """(file and start, file size, bytes with their closing braces again, pieces) of runs of one split."""
    for batch in batches:
        starts = batch.column(1).to_numpy(zero_copy_only=False)
        files = pa.array(batch.column(0)).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        change = np.flatnonzero((starts[1:] != starts[:-1]) | (files[1:] != files[:-1])) + 1
        for low, high in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
            if low == high:
                continue
            part = batch.slice(low, high - low)
            value = pa.concat_arrays([part.column(3).cast(pa.large_binary())])
            ends = np.frombuffer(value.buffers()[1], np.int64)[value.offset : value.offset + len(value) + 1]
            data = value.buffers()[2]
            flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
            raw = np.full(len(flat) + len(value), _CUT, np.uint8)
            raw[np.arange(len(flat)) + np.repeat(np.arange(len(value)), np.diff(ends))] = flat
            yield (part.column(0)[0].as_py(), int(starts[low])), part.column(2)[0].as_py(), raw, len(value)


def _structure(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte: quotes before it (odd: 1), and whether it opens (1) or closes (-1) a level."""
    at = np.arange(len(raw))
    plain = np.maximum.accumulate(np.where(raw != _ESCAPE, at, -1))
    escapes = np.concatenate([[0], (at - plain)[:-1]])  # backslashes in a row before the byte
    quote = (raw == _QUOTE) & (escapes % 2 == 0)
    odd = (np.cumsum(quote) - quote) & 1
    step = np.isin(raw, (ord("{"), ord("["))).astype(np.int64) - np.isin(raw, (ord("}"), ord("]")))
    return np.append(odd, int(quote.sum()) & 1), step


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every split: how many bytes and pieces, quotes (odd: 1) and levels if it starts outside or inside a string."""
    known: dict[tuple[str, int], list] = {}
    for key, size, raw, pieces in _splits(batches):
        odd, step = _structure(raw)
        levels = [int(step[odd[:-1] == side].sum()) for side in (0, 1)]
        state = known.setdefault(key, [size, 0, 0, 0, 0, 0, None])
        parity = state[3]
        state[1] += len(raw) - pieces
        state[2] += pieces
        state[4] += levels[parity]
        state[5] += levels[1 - parity]
        state[3] ^= int(odd[-1])
        if not state[6]:
            # The last brace of a file may not be there, so no more than the first of these counts.
            head = raw[:4096].tobytes().removeprefix(_BOM).lstrip(_SPACE)
            state[6] = head[:1].decode("latin-1") or None
    for (file, start), state in known.items():
        columns = [file, start, *state]
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, _SUMMED, strict=True)], names=_NAMES)


_NAMES = ["file", "start", "size", "bytes", "pieces", "odd", "outside", "inside", "head"]
_SUMMED = [pa.string(), *[pa.int64()] * 7, pa.string()]


def starts_of(fragments: DataFrame) -> tuple[dict[tuple[str, int], Start], list[str], list[str]]:
    """The state at the start of every split of arrays, files that aren't arrays, and unfinished ones.

    The driver holds a few numbers for each split.
    """
    kinds = "file string, start long, size long, bytes long, pieces long, odd long, outside long, inside long, head string"
    by_file: dict[str, list] = {}
    for row in fragments.mapInArrow(_summed, kinds).toLocalIterator():
        by_file.setdefault(row["file"], []).append(row)
    out: dict[tuple[str, int], Start] = {}
    others, unfinished = [], []
    for file, rows in by_file.items():
        rows.sort(key=lambda r: r["start"])
        if rows[0]["head"] != "[":
            others.append(file)
            continue
        # One more brace than the file has; Spark leaves out a byte order mark, if there is one.
        surplus = sum(r["bytes"] + r["pieces"] for r in rows) - rows[0]["size"]
        open_end = surplus in (1, 1 - len(_BOM))
        inside, depth = 0, 0
        for i, row in enumerate(rows):
            out[file, row["start"]] = Start(inside, depth, i == 0, i == len(rows) - 1, open_end)
            depth += row["inside"] if inside else row["outside"]
            inside ^= row["odd"]
        if inside or depth + open_end != 0:
            unfinished.append(file)
    return out, others, unfinished


def _objects(fragments: DataFrame, starts: dict[tuple[str, int], Start]) -> DataFrame:
    """``file, start, place, role, first, last, value``: texts that end with an object of the array.

    Role 0 is a whole text, with the comma or bracket before the object; 1 begins one that goes on in
    the next split, 2 goes on with one. Place orders the parts of a split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, place, rest, inside, depth, ended = None, 0, b"", 0, 0, False
        here: Start | None = None

        def row(values: list[bytes], roles: list[int]) -> pa.RecordBatch:
            nonlocal place
            n = len(values)
            first = [here.first and place + i == 0 for i in range(n)]
            last = [here.last and role != 0 and i == n - 1 and not values_end for i, role in enumerate(roles)]
            out = pa.RecordBatch.from_arrays(
                [pa.array([split[0]] * n, pa.string()), pa.array([split[1]] * n, pa.int64()),
                 pa.array(np.arange(place, place + n)), pa.array(roles, pa.int32()), pa.array(first, pa.bool_()),
                 pa.array(last, pa.bool_()), pa.array([v.decode("utf-8", "replace") for v in values], pa.string())],
                names=["file", "start", "place", "role", "first", "last", "value"],
            )
            place += n
            return out

        def finish() -> Iterator[pa.RecordBatch]:
            if split is not None:
                # What follows the last object: it begins a text, or goes on with one if there was no object.
                text = rest[:-1] if here.last and here.open_end else rest
                yield row([text], [1 if ended or here.first else 2])

        values_end = True
        for key, _, raw, _ in _splits(batches):
            if key != split:
                values_end = False
                yield from finish()
                values_end = True
                if key not in starts:
                    raise RuntimeError("the file is split differently than before: read the feed anew")
                split, here, place, rest, ended = key, starts[key], 0, b"", False
                inside, depth = here.inside, here.depth
            odd, step = _structure(raw)
            outside = (odd[:-1] ^ inside) == 0
            level = depth + np.cumsum(step * outside)
            ends = np.flatnonzero((raw == _CUT) & outside & (level == 1)) + 1
            inside, depth = inside ^ int(odd[-1]), int(level[-1])
            cuts = [0, *ends.tolist(), len(raw)]
            texts = [raw[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            if len(ends):
                texts[0] = rest + texts[0]
                roles = [0] * len(ends)
                if not ended and not here.first:
                    roles[0] = 2
                yield row(texts[:-1], roles)
                rest, ended = texts[-1], True
            else:
                rest += texts[0]
        values_end = False
        yield from finish()

    return fragments.mapInArrow(
        run, "file string, start long, place long, role int, first boolean, last boolean, value string"
    )


def array_elements(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, list[str]]:
    """``value, broken`` for every object of the arrays in files, and the files that are no arrays.

    ``broken`` tells what is no JSON between or after the objects; such rows have no value. A file
    whose strings or brackets don't end has a broken row. Texts are UTF-8. Objects are cut, not checked.
    """
    fragments = _fragments(spark, path)
    starts, others, unfinished = starts_of(fragments)
    arrays = fragments.filter(~F.col("file").isin(others)) if others else fragments
    parts = _objects(arrays, starts)
    whole = parts.filter("role = 0").select("value", "first", "last")
    order = Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    crossing = parts.filter("role > 0").withColumn("text", F.sum((F.col("role") == 1).cast("long")).over(order))
    joined = crossing.groupBy("file", "text").agg(
        F.array_sort(F.collect_list(F.struct("start", "place", "value"))).alias("all"),
        F.max("first").alias("first"), F.max("last").alias("last"),
    ).select(F.array_join(F.transform("all", lambda p: p["value"]), "").alias("value"), "first", "last")
    texts = whole.unionByName(joined)
    lead = F.when(F.col("first"), "[").otherwise(",")
    trimmed = F.regexp_replace("value", r"^\uFEFF?[ \t\r\n]+|^\uFEFF", "")
    after = F.regexp_replace(F.col("value"), r"[\uFEFF \t\r\n]", "")
    ends_well = after == F.when(F.col("first"), "[]").otherwise("]")
    begins_well = F.substring(trimmed, 1, 1) == lead
    text = F.when(F.col("last"), F.lit(None)).when(begins_well, F.expr("substring(trimmed, 2)"))
    broken = F.when(F.col("last") & ~ends_well, F.col("value")).when(~F.col("last") & ~begins_well, F.col("value"))
    found = texts.withColumn("trimmed", trimmed).select(text.alias("value"), broken.alias("broken"))
    found = found.filter("value is not null or broken is not null")
    if unfinished:
        rows = spark.createDataFrame([(None, f"unfinished array in {name}") for name in unfinished], found.schema)
        found = found.unionByName(rows)
    return found, others
