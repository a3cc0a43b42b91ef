"""Connected components of an edge table, by alternating large and small stars.

Every round is a partial aggregation and a join; the edges of a round are
written to the shared folder, so its lineage ends there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, settled


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``u, v, m``; the join can be split where one node has very many edges."""
    return edges.join(least.select(apart(F.col("u")).alias("_u"), "m"), apart(F.col("u")) == F.col("_u")).drop("_u")


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = _with_least(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return small.where("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` for every node with an edge but the roots; ``root`` is its component's least node.

    ``edges`` has two integer columns, read as ``u`` and ``v``; loops and nulls are ignored.
    """
    u, v = edges.columns
    now = edges.select(F.greatest(F.col(u), F.col(v)).alias("u"), F.least(F.col(u), F.col(v)).alias("v")).where("u > v").distinct()
    now, before = settled(now, name), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        now = settled(_stars(now), name)
