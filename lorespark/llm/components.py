"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.operators.joins import materialize


def _stars(towards: DataFrame) -> DataFrame:
    """Every (u, v) with ``low``, the least of u and its neighbours; groups are never gathered."""
    least = towards.groupBy("u").agg(F.min("v").alias("low"))
    return towards.join(least, "u").withColumn("low", F.least("u", "low"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _stars(both).filter("v > u").select(
        F.greatest("v", "low").alias("u"), F.least("v", "low").alias("v")).filter("u <> v").distinct()
    small = _stars(large)
    leaves = small.select(F.col("v").alias("u"), F.col("low").alias("v"))
    return leaves.unionAll(small.select("u", F.col("low").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of ``edges`` (a, b: long); the root is the least node reachable.

    Every round is a written table, so a lost executor costs a part of one round. Rounds grow
    with the logarithm of the nodes; the loop ends when a round changes nothing.
    """
    current = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u <> v").distinct())
    seen = None
    while True:
        sign = tuple(current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if sign == seen:
            break
        seen, current = sign, materialize(_round(current))
    roots = current.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
