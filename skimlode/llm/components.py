"""Connected components of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges in a file of a round, and files that a round may have however few they are.
FILE_EDGES, LEAST_FILES = 5000, 16


def _with_least(edges: DataFrame) -> DataFrame:
    """Each directed edge (u, v) with the least of u and all its neighbours."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """node, root: of each node that has a link, the least node reachable. links: columns a, b of any orderable type.

    Large-star: each node's larger neighbours get its least neighbour; small-star: its smaller ones do. Both keep
    connectivity and shorten paths; when nothing changes every node hangs on its root. Minima are combined before the
    shuffle. The join that gives them to a node's edges streams these, so a hub needs no memory, but time: its edges are
    one partition's, unless adaptive execution splits it. Loops and repeated links change nothing; no links, no rows.
    Each round is written to the shared folder, in as many files as its edges need: no round has more than the first.
    """
    edges = common.stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    before, files = None, max(LEAST_FILES, edges.count() // FILE_EDGES)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = common.stored(large.where("u <> v").distinct(), label, files)
        small = _with_least(large)
        out = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = common.stored(out.where("u <> v").distinct(), label, files)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
