"""Connected components of an edge table by alternating large stars and small stars.

Each half step groups edges by node with partial aggregation and joins the minima back; the joins read written
tables on both sides, so adaptive execution splits the edges of a hub. Edges never come to the driver, which only
sees a count and a sum of hashes to know when nothing changes. Rounds: about the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, stage_table


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the least of the node and its neighbours."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stage_table(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")), "star-least")
    out = stage_table(both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "star-large")
    drop_table(least)
    return out


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours all go to the least of them. Edges have a > b."""
    least = stage_table(edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "star-least")
    joined = edges.join(least, F.col("a") == F.col("u"))
    moved = joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = stage_table(moved.distinct(), "star-small")
    drop_table(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b of any order) to node, root: root is the least node of the component; roots are left out."""
    now = stage_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star-edges")
    state = _state(now)
    while state[0]:
        large = _large(now)
        small = _small(large)
        after = _state(small)
        drop_table(now)
        drop_table(large)
        now = small
        if after == state:
            break
        state = after
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._staged_path = now._staged_path  # for drop_table
    return out
