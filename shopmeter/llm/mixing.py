"""Mixing sources to target weights by thresholds on a hash, without sorting rows.

Every row has a hash. A source's wanted number of words is so many whole passes over
it and a rest; the rest is taken from the rows whose hash lies below a threshold. The
threshold comes from histograms of words by source and hash bucket: the bucket in
which the budget runs out is cut into finer buckets, and so on until the hash's last
bits. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopmeter.llm.common import WORD
from shopmeter.session import durable

#: The hash's bits, and those that one histogram tells apart.
HASH_BITS, LEVEL_BITS = 48, 12
#: Bits of the number by which rows of one hash, equal in key and text, are told apart.
TURN_BITS = 36
#: Up to so many sources, their thresholds (a few numbers each) travel to every task.
BROADCAST_SOURCES = 50_000


def text_size(text: str = "text") -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(key: str = "doc_id", text: str = "text", seed: str = "") -> Column:
    """48 bits of a digest of key and text: only rows equal in both share it."""
    digest_of_text = F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"))
    named = F.concat(F.lit(seed), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.lit("|"), digest_of_text)
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def row_turn() -> Column:
    """36 bits that tell equal rows apart, by their place in the table."""
    return F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - TURN_BITS)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``source, source_size`` (one row per source) with its ``target`` number of words.

    Sources in code-point order, null last, get the weights in turn and share all words
    by them. A target stops at ``most`` times its source's size; the excess goes to the
    others by weight until none is above. Sources with no words have target 0.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(turn) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), place + 1).cast("long")
    capped = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("cap"))
    # Filled up in order of cap / weight: a source is full if its cap lies below the level
    # that all words left over by the fuller ones would give it and those after it.
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    leveled = capped.withColumn("level", left.cast("double") / F.sum("w").over(after))
    open_ = F.col("cap") > F.col("w") * F.col("level")
    leveled = leveled.withColumn("open", open_).withColumn("place", F.row_number().over(order))
    level = F.min(F.when(F.col("open"), F.struct("place", "level"))).over(whole)["level"]
    shared = F.col("w") * level
    target = F.when(level.isNull() | (F.col("cap") <= shared), F.col("cap").cast("double")).otherwise(shared)
    return leveled.select("source", "source_size", target.alias("target"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


_NAMES = ["source", "source_size", "target", "passes", "budget"]


def _narrowed(rows: DataFrame, state: DataFrame, column: str, bits: int, count: int) -> DataFrame:
    """``state`` with the ``prefix`` of ``column`` at which each source's budget runs out.

    ``below`` are the words before it, ``at`` those that share it. Every round cuts the bucket
    that holds the end of the budget into finer ones.
    """
    state = state.withColumns({"prefix": F.lit(0).cast("long"), "at": F.lit(0).cast("long")})
    known = 0
    while known < bits:
        known += LEVEL_BITS
        bucket = F.shiftright(column, bits - known)
        edge = state.select(F.col("source").alias("of"), F.col("prefix").alias("edge"))
        inside = rows.withColumn("bucket", bucket).join(
            _small(edge, count),
            F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("bucket", LEVEL_BITS) == F.col("edge")),
        )
        histogram = inside.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
        joined = histogram.withColumnRenamed("source", "of").join(
            _small(state.select(*_NAMES, "below"), count), F.col("of").eqNullSafe(F.col("source"))
        )
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        summed = joined.withColumn("below", F.col("below") + F.coalesce(F.sum("words").over(run), F.lit(0)))
        # The last bucket that starts within the budget holds its end.
        found = F.max(F.struct("bucket", "below", "words"))
        state = durable(
            summed.filter(F.col("below") <= F.col("budget"))
            .groupBy(*_NAMES)
            .agg(found.alias("m"))
            .select(*_NAMES, F.col("m.bucket").alias("prefix"), F.col("m.below").alias("below"), F.col("m.words").alias("at"))
        )
    return state


def thresholds(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Per source of ``rows`` (hash, turn, size, source): its target, passes and thresholds.

    ``passes`` rows are taken whole so many times; once more those with ``hash < threshold``
    and, of the rows with that very hash, which are equal, those with ``turn < turns``. The
    thresholds are the ones whose words come nearest to the budget (the lower if two are as near).
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sized = durable(targets(sizes, weights, most))
    count = sized.count()
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = sized.withColumn("passes", passes.cast("long")).withColumn(
        "budget", F.col("target") - F.col("passes") * F.col("source_size")
    )
    state = _narrowed(rows, state.withColumn("below", F.lit(0).cast("long")), "hash", HASH_BITS, count)
    edge = state.select(F.col("source").alias("of"), F.col("prefix").alias("threshold"))
    same = F.col("source").eqNullSafe(F.col("of"))
    equal = rows.join(_small(edge, count), same & (F.col("hash") == F.col("threshold"))).drop("of", "threshold")
    last = _narrowed(durable(equal), state.select(*_NAMES, "below"), "turn", TURN_BITS, count)
    nearer = 2 * (F.col("budget") - F.col("below")) > F.col("at")
    turns = last.select(F.col("source").alias("of"), (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("turns"))
    state = state.select("source", "source_size", "target", "passes", F.col("prefix").alias("threshold"))
    return state.join(_small(turns, count), same).drop("of")


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "",
) -> DataFrame:
    """How often the mix takes every row.

    Returns all columns of ``docs`` in the struct ``row``, with ``size`` (words), ``source_size``, ``target`` (words wanted of the row's source)
    and ``times`` (0 to ``most``). Null texts have size 0; a null source is a source of its
    own, the last; rows that share a key, or have none, are taken each by its own text. Of rows
    equal in key and text some can be taken once more than the others, told apart by their place
    in the table: read ``docs`` from written data, not from a plan that deals rows anew. The same
    rows give the same mix, in any order and on any number of machines.
    """
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        row_hash(key, text, seed).alias("hash"),
        row_turn().alias("turn"),
        text_size(text).alias("size"),
        F.col(f"`{source}`").alias("source"),
    )
    limits = thresholds(durable(keyed.select("hash", "turn", "size", "source")), weights, most)
    return apply(keyed, limits)


def apply(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` (hash, turn, size, source and any others) with their source's target and ``times``."""
    limits = limits.withColumnRenamed("source", "of")
    joined = rows.join(_small(limits, limits.count()), F.col("source").eqNullSafe(F.col("of")))
    equal = (F.col("hash") == F.col("threshold")) & (F.col("turn") < F.col("turns"))
    times = F.col("passes") + F.when((F.col("hash") < F.col("threshold")) | equal, 1).otherwise(0)
    return joined.withColumn("times", times).drop("of", "passes", "threshold", "turns", "hash", "turn")
