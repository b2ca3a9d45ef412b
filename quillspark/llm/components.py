"""Connected components of a graph given by its edges, by alternating large-star and small-star steps.

Each round is a few joins and sums; its result is checkpointed, so a lost executor costs one round at most. Edges and
components stay distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, on_split_key


def _with_least(edges: DataFrame) -> DataFrame:
    """edges and, as m, the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return on_split_key(edges, least, "u")


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node that can be reached, so node itself for one.

    edges: two columns of one comparable type, in any direction, repeated or not. Edges with a null end or from a node
    to itself are left out. An empty frame gives an empty one. Rows at the centre of a star can be split over tasks.
    """
    sums = {"rows": F.count(F.lit(1)), "sum": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    e = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col("u") != F.col("v")))
    e = materialize(e.distinct(), **sums)
    seen = None
    while e.seen["rows"] and e.seen != seen:
        seen, last = e.seen, e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Larger neighbours link to the least neighbour ...
        large = _with_least(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # ... then smaller neighbours, and the node itself, do.
        small = _with_least(large)
        out = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        e = materialize(out.select("e.u", "e.v").filter(F.col("u") != F.col("v")).distinct(), **sums)
        discard(last)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
