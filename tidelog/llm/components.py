"""Connected components of a link table by contraction, wholly in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut, free


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the (a, b) links with a and b apart; comp is the smallest node reachable.

    Each pass points every component at its smallest neighbour, follows the
    pointers to their roots by doubling, and contracts the links. Both loops
    take a number of passes logarithmic in the length of the longest chain.
    """
    links = cut(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi > lo").distinct())
    size = links.count()  # of the Parquet footers; no later table has more rows than twice as many
    nodes = links.select(F.col("hi").alias("node")).union(links.select(F.col("lo").alias("node"))).distinct()
    labels = cut(nodes.select("node", F.col("node").alias("comp")), 2 * size)
    while size:
        to = cut(links.groupBy("hi").agg(F.min("lo").alias("to")), size)
        while True:
            up = to.select(F.col("hi").alias("to"), F.col("to").alias("up"))
            hop = cut(to.select("hi", "to").join(up, "to", "left").select("hi", F.coalesce("up", "to").alias("to"), F.col("up").isNotNull().alias("moved")), size)
            free(to)
            to = hop
            if not hop.filter("moved").take(1):
                break
        root = to.select("hi", F.col("to").alias("root"))
        known = labels
        labels = cut(known.join(root, known["comp"] == root["hi"], "left").select("node", F.coalesce("root", "comp").alias("comp")), 2 * size)
        high = links.join(root, "hi", "left").select("lo", F.coalesce("root", "hi").alias("x"))
        both = high.join(root.withColumnRenamed("hi", "lo"), "lo", "left").select("x", F.coalesce("root", "lo").alias("y"))
        left = cut(both.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).filter("hi > lo").distinct(), size)
        free(known, links, to)
        links, size = left, left.count()
    free(links)
    return labels
