"""Near copies by MinHash: an inverted join on signature coordinates, confirmed on full sets.

A coordinate of a signature is several least hashes together, so that texts which share
common word pairs only hardly ever agree in one. Texts of equal shingle sets are one class. A class is posted under its (coordinate, value)
pairs; two classes that agree in ``least`` of all coordinates must share a posting among
the rarest ``coordinates - least + 1`` of each, so only these are merged and the long lists
of common values are skipped. Agreement is then counted over the whole signatures, and
what reaches the threshold is compared set by set.

A posting list is first compared with the most central of its classes, whose values are the
commonest in all its lists: of a group of edited copies that is the original or what is
nearest to it. The classes of lists that still hold several components are then posted again,
under the rarest shingles of their sets, no more than a link must share one of, and a pair
is met only where places in the order and sizes leave room for a link: texts that were edited
apart share few of their rarest shingles, so they meet seldom, however large their group.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmeter.llm.common import chunks
from shopmeter.llm.components import components
from shopmeter.llm.words import mix, sets
from shopmeter.session import durable, release

#: Words of a shingle, least similarity in hundredths, coordinates of a signature, least
#: hashes of a coordinate, and the chance with which a pair just as similar as that may
#: agree in too few coordinates.
SHINGLE, PERCENT, COORDINATES, TOGETHER, MISS = 5, 80, 40, 3, 1e-6
#: Slots of the filter for texts whose sets are compared: 4 MB, whatever the corpus. It only
#: saves work: texts that pass it are joined with the keys wanted.
FILTER_SLOTS = 1 << 25

_DRAW = np.random.default_rng(64064)
_SEEDS = _DRAW.integers(0, 1 << 64, 256, np.uint64)
_FACTORS = _DRAW.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def least_agreement(percent: int, coordinates: int, miss: float, together: int = TOGETHER) -> int:
    """The highest threshold that a pair of that similarity misses with at most that chance."""
    p, below = (percent / 100) ** together, 0.0
    for k in range(coordinates + 1):
        below += comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if below > miss:
            return max(1, k)
    return coordinates


def signatures(hashes: np.ndarray, ends: np.ndarray, coordinates: int, together: int = TOGETHER) -> np.ndarray:
    """A row per text: its set's least hash under each function, ``together`` of them mixed to a coordinate."""
    counts = np.diff(np.concatenate([[0], ends]))
    some = np.flatnonzero(counts)
    out = np.zeros((len(ends), coordinates), np.int32)
    if len(some):
        starts = ends[some] - counts[some]
        for k in range(coordinates):
            mixed = np.zeros(len(some), np.uint64)
            for j in range(k * together, (k + 1) * together):
                value = ((hashes ^ _SEEDS[j]) * _FACTORS[j]) >> np.uint64(32)
                mixed = mix(mixed + np.minimum.reduceat(value, starts))
            out[some, k] = (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def _digests(hashes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of every set."""
    counts, out = np.diff(np.concatenate([[0], ends])), []
    for seed in (1, 2):
        mixed = mix(hashes + np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        out.append((total[ends] - total[ends - counts]).view(np.int64))
    return out


def _describe(docs: DataFrame, shingle: int, coordinates: int, together: int) -> DataFrame:
    """key, n (set size), d1, d2 (the set's 128-bit digest), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            hashes, ends = sets(batch.column(1), shingle)
            counts = np.diff(np.concatenate([[0], ends]))
            digests = _digests(hashes, ends)
            signed = signatures(hashes, ends, coordinates, together)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(ends) + 1, dtype=np.int32) * coordinates), pa.array(signed.ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts.astype(np.int64)), pa.array(digests[0]), pa.array(digests[1]), lists],
                names=["key", "n", "d1", "d2", "signature"],
            )

    return docs.mapInArrow(run, "key long, n long, d1 long, d2 long, signature array<int>")


def _filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of the keys' hashes; the driver gets its words, ``FILTER_SLOTS / 64`` at most."""
    places = F.array(F.pmod("h", F.lit(FILTER_SLOTS)), F.pmod(F.shiftrightunsigned("h", 32), F.lit(FILTER_SLOTS)))
    slots = keys.select(F.xxhash64("key").alias("h")).select(F.explode(places).alias("slot"))
    bit = F.expr("shiftleft(1L, CAST(slot % 64 AS INT))")
    words = slots.groupBy(F.floor(F.col("slot") / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(FILTER_SLOTS // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _set_table(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """``id, set`` of the classes ``id, key, d1, d2``: only sets travel, and hardly any but the wanted ones."""
    sent = docs.sparkSession.sparkContext.broadcast(_filter(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for batch in batches:
            h = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            passes = np.ones(len(h), bool)
            for slot in (h.view(np.int64) % FILTER_SLOTS, (h >> np.uint64(32)).astype(np.int64) % FILTER_SLOTS):
                passes &= (words[slot // 64] >> (slot % 64).astype(np.uint64) & np.uint64(1)).astype(bool)
            for part in chunks([batch.filter(pa.array(passes))]):
                hashes, ends = sets(part.column(1), shingle)
                raw, starts = hashes.view(np.uint8), np.concatenate([[0], ends]).astype(np.int32) * 8
                values = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(starts), pa.py_buffer(raw)])
                of = [part.column(0), *(pa.array(d) for d in _digests(hashes, ends)), values]
                yield pa.RecordBatch.from_arrays(of, names=["key", "d1", "d2", "set"])

    rows = docs.filter("key is not null").select("key", "text", F.xxhash64("key").alias("h"))
    found = rows.mapInArrow(run, "key long, d1 long, d2 long, set binary").join(wanted, ["key", "d1", "d2"])
    return found.groupBy("id").agg(F.first("set").alias("set"))


def _agreement(a: str, b: str) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)


def _similar(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (u, v) whose sets (``id, set``) are similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i in range(batch.num_rows):
                one, two = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                both = np.sort(np.concatenate([one, two]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    kept.append(i)
            yield batch.select(["u", "v"]).take(pa.array(kept, pa.int32()))

    # The set of v comes first: u may be the hub of a long list, whose set then
    # needs to reach the pairs only once a task.
    with_v = pairs.join(found.select(F.col("id").alias("v"), F.col("set").alias("b")), "v")
    with_both = with_v.join(found.select(F.col("id").alias("u"), F.col("set").alias("a")), "u")
    return durable(with_both.select("u", "v", "a", "b").mapInArrow(compare, "u long, v long"))


_CLASS = ["id", "key", "d1", "d2"]


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shingle: int, percent: int, least: int) -> DataFrame:
    """Those of the distinct pairs (u, v) that agree in enough coordinates and are similar."""
    mine = classes.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("short").alias("su"))
    other = classes.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("short").alias("sv"))
    sized = pairs.join(mine, "u").join(other, "v")
    sized = sized.filter(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))
    pairs = durable(sized.filter(_agreement("su", "sv") >= least).select("u", "v"))
    release(docs.sparkSession)
    if pairs.isEmpty():
        return pairs
    needed = pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct()
    needed = durable(classes.select(*_CLASS).join(needed, "id"))
    found = durable(_set_table(docs, needed, shingle))
    release(docs.sparkSession)
    return _similar(pairs, found, percent)


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every shingle of the sets, a bounded number at once."""
    for batch in batches:
        for i in range(batch.num_rows):
            values = np.frombuffer(batch.column(1)[i].as_buffer(), np.int64)
            for start in range(0, len(values), 1 << 16):
                part = values[start : start + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[i], len(part)), pa.array(part)], names=["id", "h"])


def _meetings(members: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of ``id, n, component`` in different components that can still be similar.

    The shingles of every set (``id, set``) are ordered by how many of these sets hold them,
    rarest first. If two sets are similar, they share a shingle, and the first one shared lies
    at places p, q of theirs such that at most ``n - p`` and ``n - q`` are common: so many
    must suffice for the sizes of both. Of the larger set places up to a fifth of it (for 80
    hundredths) have to be posted, of the smaller one up to a ninth. Members of the component
    that most of a list belongs to are not compared with each other.
    """
    posts = found.mapInArrow(_flat, "id long, h long")
    counts = posts.groupBy("h").agg(F.count("*").alias("often")).filter("often > 1")
    # Written first: a join of two plain shuffles can split a shingle that many sets have.
    shared = posts.join(durable(counts), "h")
    release(members.sparkSession)
    listed = shared.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("often", "h"))).alias("order")).join(members, "id")
    # What only one set has comes before all others and is never shared.
    listed = listed.withColumn("own", F.col("n") - F.size("order"))
    room = F.floor((100 - percent) * F.col("n") / 100) + 1 - F.col("own")
    places = F.posexplode(F.slice("order", 1, F.greatest(room, F.lit(0)).cast("int"))).alias("place", "o")
    rows = listed.select("id", "n", "component", "own", places)
    rows = rows.select("id", "n", "component", F.col("o.h").alias("h"), (F.col("n") - F.col("own") - F.col("place")).alias("left"))
    # The largest size of another set that so many common shingles suffice for.
    rows = durable(rows.withColumn("most", F.floor((100 + percent) * F.col("left") / percent) - F.col("n")))
    release(members.sparkSession)
    of = rows.groupBy("h", "component").agg(F.count("*").alias("many")).groupBy("h")
    lists = of.agg(F.max(F.struct("many", "component"))["component"].alias("main"), F.count("*").alias("kinds"))
    rows = rows.join(durable(lists.filter("kinds > 1").drop("kinds")), "h").withColumn("inside", F.col("component") == F.col("main"))
    rows = durable(rows.drop("main", "left"))
    release(members.sparkSession)
    larger = rows.select("h", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "component", "most", "inside")))
    smaller = rows.filter("most >= n")
    fits = (
        (F.col("n2") >= F.col("n")) & (F.col("n2") <= F.col("most")) & (F.col("n") <= F.col("most2"))
        & (100 * F.col("n") >= percent * F.col("n2")) & (F.col("component") != F.col("component2"))
    )
    met = []
    for one, two in ((smaller.filter("inside"), larger.filter("not inside2")), (smaller.filter("not inside"), larger)):
        one = one.withColumnRenamed("h", "g")
        met.append(one.join(two, (F.col("g") == F.col("h")) & fits).select(F.least("id", "id2").alias("u"), F.greatest("id", "id2").alias("v")))
    return met[0].unionByName(met[1]).distinct()


def near_copies(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT,
    coordinates: int = COORDINATES, together: int = TOGETHER, miss: float = MISS,
) -> DataFrame:
    """``key, n_shingles, component, kept`` of every row.

    Texts are linked whose sets of lower-cased word shingles share at least ``percent``
    hundredths of their union; ``component`` is the least key reachable over links, and
    ``kept`` says whether the row has it. Rows that share a key are one document, which has the
    links of all their texts. A text with fewer words than a shingle has one
    shingle, all of them; texts without words, empty and null ones are linked with nothing.
    Rows with a null key take no part in links and are kept, with a null component.
    Repeated rows share their component and are all kept or not. A pair of exactly
    ``percent`` is missed with a chance of at most ``miss``, more similar ones with less.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    described = durable(_describe(rows, shingle, coordinates, together))
    linkable = described.filter("n > 0 and key is not null")
    classes = linkable.groupBy("d1", "d2").agg(
        F.min("key").alias("key"), F.first("n").alias("n"), F.first("signature").alias("signature")
    )
    # Eight bits of a coordinate travel with the pairs: unlike ones seldom look alike, like ones always do.
    short = F.transform("signature", lambda x: (x.bitwiseAND(255) - 128).cast("tinyint"))
    classes = durable(classes.withColumns({"short": short, "id": F.monotonically_increasing_id()}))
    least = least_agreement(percent, coordinates, miss, together)
    merged = coordinates - least + 1

    posts = classes.select("id", F.posexplode("signature").alias("at", "value"))
    counts = posts.groupBy("at", "value").agg(F.count("*").alias("often")).filter("often > 1")
    # Written first: a join of two plain shuffles can split a value that many rows have.
    shared = posts.join(durable(counts), ["at", "value"])
    # A class's rarest postings come first; those of its own only, which no join can
    # meet, are the rarest of all and take up places of the prefix.
    ordered = F.sort_array(F.collect_list(F.struct("often", "at", "value")))
    places = F.greatest(F.lit(0), F.lit(merged) - (F.lit(coordinates) - F.size("posts")))
    prefix = shared.groupBy("id").agg(ordered.alias("posts"), F.sum("often").alias("central"))
    prefix = prefix.select("id", "central", F.explode(F.slice("posts", 1, places)).alias("p"))
    prefix = durable(prefix.select("id", "central", "p.at", "p.value"))
    release(spark)

    # Every list's classes against the most central of them.
    listed = ["at", "value"]
    hub = prefix.groupBy(listed).agg(F.max(F.struct("central", (-F.col("id")).alias("less"))).alias("hub"))
    stars = prefix.join(hub.select(*listed, (-F.col("hub.less")).alias("u")), listed)
    stars = durable(stars.filter("u <> id").select("u", F.col("id").alias("v")).distinct())
    release(spark)
    links = _confirmed(stars, classes, rows, shingle, percent, least)
    bridges = _bridges(linkable, classes)
    if bridges is not None:
        links = durable(links.unionByName(bridges))
    release(spark)
    found = durable(components(links))
    release(spark)

    # Lists that hold several components: their classes against those of the others.
    member = prefix.join(found.withColumnRenamed("node", "id"), "id", "left")
    member = member.withColumn("component", F.coalesce("component", "id"))
    mixed = member.groupBy(listed).agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b")
    member = durable(member.join(mixed.select(listed), listed).select("id", "component").distinct())
    if not member.isEmpty():
        open_ = durable(member.join(classes.select(*_CLASS, "n"), "id"))
        sets_ = durable(_set_table(rows, open_.select(*_CLASS), shingle))
        release(spark)
        pairs = durable(_meetings(open_.select("id", "n", "component"), sets_, percent))
        release(spark)
        more = _similar(pairs, sets_, percent)
        if not more.isEmpty():
            # The components found are edges to their least nodes already.
            stars = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
            found = durable(components(stars.unionByName(more)))
        del open_, sets_, pairs, more
    del posts, counts, shared, prefix, stars, links, member
    release(spark)

    joined = classes.select("id", "d1", "d2", "key").join(found.withColumnRenamed("node", "id"), "id", "left")
    joined = joined.withColumn("whole", F.coalesce("component", "id"))
    first = joined.groupBy("whole").agg(F.min("key").alias("component"))
    of_class = joined.select("d1", "d2", "whole").join(first, "whole").drop("whole")
    joined = described.select("key", "n", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    component = F.when((F.col("n") > 0) & F.col("key").isNotNull(), F.col("component")).otherwise(F.col("key"))
    return joined.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component"),
        F.coalesce(F.col("key") == component, F.col("key").isNull()).alias("kept"),
    )


def _bridges(linkable: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links (u, v) between classes that hold different texts of one key, None without any."""
    several = linkable.groupBy("key").agg(
        F.min(F.struct("d1", "d2")).alias("a"), F.max(F.struct("d1", "d2")).alias("b")
    ).filter("a <> b").select("key")
    texts = durable(linkable.join(several, "key").select("key", "d1", "d2").distinct())
    if texts.isEmpty():
        return None
    named = texts.join(classes.select("d1", "d2", "id"), ["d1", "d2"]).select("key", "id")
    first = named.groupBy("key").agg(F.min("id").alias("u"))
    return named.join(first, "key").filter("u <> id").select("u", F.col("id").alias("v")).distinct()
