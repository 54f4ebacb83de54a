"""Connected components by alternating large-star and small-star contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import dropped, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hang every neighbour (large: the greater ones of both directions; small: the lesser ones) on the least one."""
    sides = edges.union(edges.select("v", "u")) if large else edges
    least = sides.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = sides.join(least, F.col("u") == F.col("k"))
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of longs -> (node, root): each node of an edge and the least node that it reaches.

    Every pass is written to the shared folder, so lineage stays short and no link is collected.
    An edge table without rows gives none; self-links only give none.
    """
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    state = _state(edges)
    while state[0]:
        after = stored(_stars(_stars(edges, True), False), "links")
        changed = _state(after)
        dropped(edges)
        edges = after
        if changed == state:
            break
        state = changed
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
