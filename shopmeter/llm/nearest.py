"""Nearest neighbours by inner product: a block matrix join over int8 tiles.

Vectors are packed into blocks, each also as int8 with the size of what rounding lost.
A product of int8 blocks gives every pair's inner product within a proven bound; only
pairs that may still reach a query's nearest are computed again from the original
values, and the query's heap keeps the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block of candidates and queries in a block of queries.
BLOCK, QUERY_BLOCK = 2_048, 1_024
#: The candidates' blocks are dealt to so many tasks for each block of queries.
SLOTS = 32
#: Pairs whose exact product is computed at once.
PAIRS = 200_000

_BLOCK_SCHEMA = "part int, seq int, dim int, n int, ids binary, vectors binary"


def usable(embedding: str) -> Column:
    """True for vectors with components, all of them finite and not all zero."""
    values = F.col(embedding).cast("array<double>")
    broken = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~broken & F.exists(values, lambda x: x != 0), F.lit(False))


def _pack(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            vectors = batch.column(1)
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            lengths = np.diff(vectors.offsets.to_numpy())
            starts = np.cumsum(lengths) - lengths
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                values = flat[starts[rows][:, None] + np.arange(dim)]
                old = held.pop(dim, (ids[:0], values[:0]))
                all_ids, values = np.concatenate([old[0], ids[rows]]), np.concatenate([old[1], values])
                while len(all_ids) >= size:
                    yield _block(part, seq, dim, all_ids[:size], values[:size])
                    all_ids, values, seq = all_ids[size:], values[size:], seq + 1
                if len(all_ids):
                    held[dim] = (all_ids, values)
        for dim, (all_ids, values) in held.items():
            yield _block(part, seq, dim, all_ids, values)
            seq += 1

    return run


def _block(part: int, seq: int, dim: int, ids: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()),
         pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(values, np.float64).tobytes()], pa.binary())],
        names=["part", "seq", "dim", "n", "ids", "vectors"],
    )


class Quantised:
    """Vectors as int8 times a scale each, with the lengths that bound the error."""

    def __init__(self, vectors: np.ndarray):
        self.scale = np.abs(vectors).max(1) / 127
        safe = np.where(self.scale > 0, self.scale, 1)
        whole = np.clip(np.rint(vectors / safe[:, None]), -127, 127)
        # Products of int8 values are whole numbers, exact in these types.
        self.values = whole.astype(np.float32 if vectors.shape[1] <= 1040 else np.float64)
        kept = whole * safe[:, None]
        self.lost = np.linalg.norm(vectors - kept, axis=1)
        self.kept = np.linalg.norm(kept, axis=1)
        self.norm = np.linalg.norm(vectors, axis=1)


class Heaps:
    """The k nearest found so far of every query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.quantised = Quantised(vectors)
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        mine, other = self.quantised, Quantised(vectors)
        near = (mine.values @ other.values.T) * mine.scale[:, None] * other.scale[None, :]
        # <q,c> - <q',c'> = <q-q',c> + <q',c-c'>; a little more for rounding in doubles.
        slack = np.outer(mine.lost, other.norm) + np.outer(mine.kept, other.lost)
        slack += 1e-9 * np.outer(mine.norm, other.norm) + 1e-300
        own = self.ids[:, None] == ids[None, :]
        floor = self.scores[:, -1]
        if len(ids) > self.k:
            least = np.where(own, -np.inf, near - slack)
            floor = np.maximum(floor, np.partition(least, -self.k, axis=1)[:, -self.k])
        rows, columns = np.nonzero((near + slack >= floor[:, None]) & ~own)
        for start in range(0, len(rows), PAIRS):
            self._merge(ids, vectors, rows[start : start + PAIRS], columns[start : start + PAIRS])

    def _merge(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        exact = np.zeros(len(rows))
        for d in range(vectors.shape[1]):
            exact += self.vectors[rows, d] * vectors[columns, d]
        hit = exact >= self.scores[rows, -1]
        rows, exact, candidates = rows[hit], exact[hit], ids[columns[hit]]
        touched = np.unique(rows)
        rows = np.concatenate([rows, np.repeat(touched, self.k)])
        exact = np.concatenate([exact, self.scores[touched].ravel()])
        candidates = np.concatenate([candidates, self.found[touched].ravel()])
        order = np.lexsort((candidates, -exact, rows))
        rows, exact, candidates = rows[order], exact[order], candidates[order]
        first = np.searchsorted(rows, touched)
        best = first[:, None] + np.arange(self.k)
        self.scores[touched], self.found[touched] = exact[best], candidates[best]

    def rows(self) -> pa.RecordBatch:
        full = self.scores > -np.inf
        at = np.nonzero(full)[0]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[at]), pa.array(self.found[full]), pa.array(self.scores[full])], names=["query_id", "near_id", "score"]
        )


def nearest(
    vectors: DataFrame, queries: Column, key: str = "vec_id", embedding: str = "embedding", k: int = 20,
    block: int = BLOCK, query_block: int = QUERY_BLOCK, every_row: bool = False,
) -> DataFrame:
    """The ``k`` nearest by inner product of every row for which ``queries`` holds.

    Returns ``query_id``, ``rank`` (from 1), ``near_id`` and ``score``, the product of the
    original values in double precision; equal scores go by the smaller key. A row is
    never near to itself or a row of its own key; vectors are compared with those of
    their own length only. Vectors that are null, empty, zero or hold a null or
    non-finite component take no part, nor do rows with a null key. Of the usable vectors
    that share a key the least counts, as a query if any of its rows is one; with
    ``every_row`` each of them is a candidate and, if its row asks, a query, and the ``k``
    nearest of a key are those of all its queries, a near key once for every such pair.
    """
    rows = vectors.select(
        F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"),
        F.coalesce(queries, F.lit(False)).alias("asks"),
    ).filter(F.col("id").isNotNull() & usable("v"))
    counted = rows.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("asked")).first()
    n_blocks = max(1, -(-counted.n // block))
    n_queries = max(1, -(-(counted.asked or 0) // query_block))
    slots = max(1, min(SLOTS, n_blocks))

    if not every_row:
        # One vector per key: the least of those that share it.
        rows = rows.groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    candidates = rows.select("id", "v").repartition(n_blocks).mapInArrow(_pack(block), _BLOCK_SCHEMA)
    asking = rows.filter("asks").select("id", "v").repartition(n_queries).mapInArrow(_pack(query_block), _BLOCK_SCHEMA)
    payload = ["dim", "n", "ids", "vectors"]
    # A block of queries goes to every slot, a block of candidates to its slot for each
    # group of queries: rows of queries first, then the candidates one by one.
    asking = asking.select(
        F.col("part").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"), F.lit(0).alias("kind"), "seq", *payload
    )
    candidates = candidates.select(
        F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("g"),
        F.pmod(F.xxhash64("part", "seq"), F.lit(slots)).cast("int").alias("slot"), F.lit(1).alias("kind"),
        "seq", *payload,
    )
    dealt = asking.unionByName(candidates).repartition(slots * n_queries, "g", "slot").sortWithinPartitions("g", "slot", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heaps = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                g, slot, kind, _, dim, n, ids, values = (c[i].as_py() for c in batch.columns)
                if (g, slot) != at:
                    yield from (h.rows() for h in heaps)
                    at, heaps = (g, slot), []
                ids = np.frombuffer(ids, np.int64)
                values = np.frombuffer(values, np.float64).reshape(n, dim)
                if kind == 0:
                    heaps.append(Heaps(ids, values, k))
                    continue
                for h in heaps:
                    if h.vectors.shape[1] == dim:
                        h.add(ids, values)
        yield from (h.rows() for h in heaps)

    found = dealt.mapInArrow(search, "query_id long, near_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "near_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "near_id", "score")
