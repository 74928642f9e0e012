"""Connected components of a link table, as rounds of joins.

Alternates two steps over edges ``(u, v)`` with ``u > v``: each node hands its
larger neighbours to its smallest one, then its smaller neighbours. Both reduce to a
minimum per node (pre-aggregated in each task) and one join, so a node with a huge
number of links is never gathered anywhere. Every round is stored in the shared
checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cribra.llm.common import stored


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.where("v > u").join(low, "u").where("v > m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``node``, ``root`` for every node that has a link to another one.

    ``root`` is the smallest node of the component. Links may repeat, point
    either way or to themselves; rows with a null end are ignored.
    """
    edges = (links.where(F.col(a) != F.col(b))
             .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    edges = stored(edges)
    mark = None
    for _ in range(max_rounds):
        edges = stored(_small(_large(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
