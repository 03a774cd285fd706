"""What the text operators share: batches of whole texts, word hashes, folds."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a longest run of characters other than blanks and ASCII line characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts of about so many bytes are worked on at once inside a task.
CHUNK_BYTES = 256_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the rows whose labels may not be learnt."""
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5
    return F.coalesce(remainder == 0, F.lit(False))


#: What a Python worker keeps for the next task: the tables of one operator.
_KEPT: dict[tuple[str, int], Any] = {}


def kept(owner: str, key: int, make: Callable[[], Any]) -> Any:
    """``make()``, kept by this worker until a task of another operator or key runs in it."""
    if (owner, key) not in _KEPT:
        _KEPT.clear()
        _KEPT[owner, key] = make()
    return _KEPT[owner, key]


def _release() -> None:
    """Give memory that the worker no longer uses back to the machine; idle workers stay alive."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(
    batches: Iterable[pa.RecordBatch], text: int = 1, most: int = CHUNK_BYTES, keeps: bool = False
) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes in column number ``text``.

    Rows are never cut: a longer text is a slice of its own. Unless the operator ``keeps`` tables
    of its own, what another one left in this worker goes.
    """
    if not keeps:
        _KEPT.clear()
    yield from _slices(batches, text, most)
    _release()


def _slices(batches: Iterable[pa.RecordBatch], text: int, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + most, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


def schema_of(rows: DataFrame, first: str, added: str, *last: str) -> T.StructType:
    """Columns ``first`` and ``last`` of ``rows`` as they are, and those of ``added`` between them."""
    return T.StructType([rows.schema[first], *T.StructType.fromDDL(added).fields, *(rows.schema[c] for c in last)])
