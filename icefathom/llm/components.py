"""Connected components of a table of links, spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icefathom.session import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link: root is the least node of its component.

    Every round, each node's root becomes the least root among its neighbours, then the
    root's root, so that known ways double in length. Each round is stored, and with it the
    planner's estimates are dropped, which every join would multiply. Aggregates combine before they shuffle, so a node with very many links is
    summed where its links lie.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u") != F.col("v"))
    edges = ends.union(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).checkpoint()
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("root")).checkpoint()
    while True:
        # The least root that a node's neighbours have.
        seen = edges.join(roots.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        # Stored: both sides of the next join are then plain shuffles, and a large component splits.
        hooked = roots.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("up")).checkpoint()
        # Jumping: take the root's root.
        above = hooked.select(F.col("node").alias("up"), F.col("up").alias("top"))
        new = stored(hooked.join(above, "up", "left").select("node", "old", F.least("up", F.coalesce("top", "up")).alias("root")))
        roots = new.select("node", "root")
        if new.filter(F.col("old") != F.col("root")).isEmpty():
            return roots
