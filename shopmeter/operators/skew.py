"""Joins of a large table whose keys are uneven with one row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmeter.session import durable


def will_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own estimate of the size lets it broadcast ``df``, so that no key can be hot."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return 0 <= int(str(size)) <= int(limit)


def heavy_keys(df: DataFrame, key: str, parts: int | None = None) -> list:
    """Keys with more rows than an even share of ``parts`` tasks; there are fewer than ``parts``.

    Counts are summed before they travel; only the heavy keys come to the driver.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = durable(df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [row[0] for row in counts.filter(F.col("n") * parts > total).select(key).collect()]


def split_join(large: DataFrame, small: DataFrame, key: str, how: str = "inner", parts: int | None = None) -> DataFrame:
    """``large`` joined with ``small`` on ``key``; ``how`` is ``inner`` or ``left``.

    Rows of heavy keys stay where they are: the rows of ``small`` for these keys, fewer than
    there are tasks if its keys are unique, travel to all of them. The others are joined plainly.
    If Spark can broadcast ``small`` as a whole, nothing is counted. Counting reads the key
    column once more.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join: {how}")
    heavy = [] if will_broadcast(small) else heavy_keys(large, key, parts)
    if not heavy:
        return large.join(small, key, how)
    is_heavy = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    plain = large.filter(~is_heavy).join(small.filter(~is_heavy), key, how)
    hot = large.filter(is_heavy).join(F.broadcast(small.filter(is_heavy)), key, how)
    return plain.unionByName(hot)
