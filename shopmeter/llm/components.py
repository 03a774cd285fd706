"""Connected components of an edge table by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopmeter.session import durable, release


def _ends(edges: DataFrame) -> DataFrame:
    """Every edge from both of its ends, in the tasks that hold the edges."""
    there, back = F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    return edges.select(F.explode(F.array(there, back)).alias("end")).select("end.*")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the node's least neighbour instead (edges have u > v)."""
    least = _ends(edges).groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    above = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    return above.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lower neighbours are linked to the least of them (edges have u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return linked.filter("u <> v").distinct()


def _is_done(edges: DataFrame) -> bool:
    """Whether all edges lead to the least nodes: a node with a lower neighbour has no other one."""
    around = _ends(edges).groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return around.filter("low < u and low < high").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` edges to ``node, component``: the least node reachable.

    Only nodes that have an edge appear, the least ones of components included. Every
    step is a few joins and aggregates; nothing but whether a node is left that must be
    moved comes to the driver. A node with many neighbours is aggregated before the
    shuffle and its join can be split. What a step has used goes before the next one.
    """
    spark = edges.sparkSession
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = durable(edges.filter("u <> v").distinct())
    while not _is_done(edges):
        release(spark)
        edges = durable(_small_star(_large_star(edges)))
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
