"""Connected components of a link table, by the smallest node that each can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """links: a, b. node, root for every node that has a link; nodes of one component share the root.

    Each round gives a node the smallest root among its own and its neighbours', then the root's root, so stars take two rounds and chains
    the logarithm of their length, about. Rounds are written out; nothing but the number of changes comes to the driver."""
    both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "cc-links")
    roots = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")), "cc-roots")
    while True:
        seen = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        near = materialise(roots.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")), "cc-near")
        up = near.select(F.col("node").alias("root"), F.col("root").alias("over"))
        new = materialise(near.join(up, "root").select("node", "was", F.least("root", "over").alias("root")), "cc-roots")
        roots = new.select("node", "root")
        if not new.filter("root <> was").limit(1).count():
            return roots
