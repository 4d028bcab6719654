"""Connected components of links, and a join that broadcasts only what is counted to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegate.session import cut_lineage

BROADCAST_IDS = 1_000_000


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) of every node of the links (a, b).

    Each round hangs every node on its smallest neighbour, if that is smaller, follows these pointers to their ends by doubling,
    and goes on with the links between different ends alone. So a link is read again only while its sides are apart, and the nodes
    that still have links are at least halved by two rounds. Hot nodes are only met by minima, which are taken before the shuffle."""
    names = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = cut_lineage(links.filter("a IS NOT NULL AND b IS NOT NULL").select(*names("a", "b")).distinct())
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("comp"))
    edges = edges.filter("a <> b")
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("end")))
        while True:
            further = ends.select(F.col("node").alias("end"), F.col("end").alias("next"))
            ends = cut_lineage(ends.join(further, "end").select("node", F.col("next").alias("end"), (F.col("next") != F.col("end")).alias("moved")))
            moved = not ends.filter("moved").isEmpty()
            ends = ends.select("node", "end")
            if not moved:
                break
        at = edges.join(ends.select(F.col("node").alias("a"), F.col("end").alias("x")), "a").join(ends.select(F.col("node").alias("b"), F.col("end").alias("y")), "b")
        edges = cut_lineage(at.filter("x <> y").select(*names("x", "y")).distinct())
        labels = cut_lineage(labels.join(ends.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("end", "comp").alias("comp")))
    return labels


def counted(ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """The narrow table of ids, to be broadcast if it has at most `most` rows; a larger one is joined by a shuffle."""
    fixed = cut_lineage(ids)
    return F.broadcast(fixed) if fixed.count() <= most else fixed
