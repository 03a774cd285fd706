"""Bounded samples of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmeter.session import durable


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text, label, weight, draw``: at most ``per_class`` labelled documents of either class.

    Rows are picked by a hash of their key, the same on every run. ``weight`` makes the
    classes as heavy as among all labelled rows. Rows without a key, text or label teach
    nothing; of several labels of one key the highest counts, of several texts the one with
    the least hash. The keys picked (two numbers
    each, ``2 * per_class`` of them at most) travel to all tasks, so of the table's
    texts only theirs are shuffled, one of a key and task.
    """
    known = labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    known = known.filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    known = known.withColumn("draw", F.xxhash64("id", F.lit(17)))
    total = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = None
    for value, n in sorted(total.items()):
        some = known.filter(F.col("label") == value).orderBy("draw", "id").limit(per_class)
        some = some.withColumn("weight", F.lit(n / min(n, per_class)))
        picked = some if picked is None else picked.unionByName(some)
    if picked is None:
        picked = known.withColumn("weight", F.lit(1.0))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter("text is not null")
    joined = rows.join(F.broadcast(picked), F.col("key") == F.col("id")).drop("id")
    one = F.min(F.struct(F.xxhash64("text"), "text"))["text"]
    return durable(joined.groupBy("key", "label", "weight", "draw").agg(one.alias("text")).select("key", "text", "label", "weight", "draw"))
