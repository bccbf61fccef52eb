"""Connected components over links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from deskdb.llm.common import saved


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is one node, the same for all that are connected.

    Every round, each node points to the least of itself and its neighbours, and links are redrawn between what their ends point
    to; the nodes at least halve, so rounds grow with the logarithm of the nodes. Then the pointers are followed. Minima
    combine on the map side and hot nodes occur on one side of a join only, which AQE splits. Each round's tables
    are written to the shared folder.
    """
    links = saved(links.filter("a <> b").distinct(), "links")
    rounds = []
    while links.take(1):
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select(F.col("b"), F.col("a")))
        low = saved(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("root")), "pointers")
        rounds.append(low)
        left, right = low.toDF("a", "ra"), low.toDF("b", "rb")
        links = saved(links.join(left, "a").join(right, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0]
    for low in rounds[1:]:
        found = found.join(low.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return saved(found, "roots")
