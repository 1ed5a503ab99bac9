"""Connected components of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.session import materialize


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node points its larger (or its other smaller) neighbours to its smallest."""
    if large:
        pairs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        pairs = edges
    least = pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("least"))
    joined = pairs.join(least, pairs["a"] == least["node"])
    moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
    moved = moved.where(F.col("a") > joined["node"]) if large else moved.unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node), for the nodes of edges (a, b).

    Each round halves the depth of the trees, about; the edges of a round are written to the
    shared folder, which cuts the lineage. Only two sums a round reach the driver. Edges of a
    node to itself say nothing.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "edges")
    state = None
    while True:
        e = materialize(_stars(_stars(e, large=True), large=False), "edges")
        found = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if found == state:
            break
        state = found
    heads = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads)
