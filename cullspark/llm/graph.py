"""Connected components by hooking and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """id and comp, the smallest id of its component, for every id in links (a, b).

    Each round every node hooks to its smallest neighbour, the trees are flattened, and the edges are
    relabelled, so that the nodes left at least halve; a star takes one round. Only edges between
    different components go on, and each round is written, so a lost executor costs one round at most.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    whole = cut(nodes.withColumn("comp", F.col("id")), "comps")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("p")).withColumn("p", F.least("id", "p")), "parent")
        while True:
            up = parent.select(F.col("id").alias("p"), F.col("p").alias("pp"))
            if parent.join(up, "p").where("pp <> p").isEmpty():
                break
            parent = cut(parent.join(up, "p").select("id", F.col("pp").alias("p")), "parent")
        to = parent.select(F.col("id").alias("comp"), "p")
        whole = cut(whole.join(to, "comp", "left").select("id", F.coalesce("p", "comp").alias("comp")), "comps")
        ends = edges.join(parent.select(F.col("id").alias("a"), F.col("p").alias("pa")), "a").join(parent.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b")
        edges = cut(ends.where("pa <> pb").select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct(), "edges")
    return whole
