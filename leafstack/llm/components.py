"""Connected components of an edge table by rounds of contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """`edges` (a, b) -> (node, root): the smallest node that each node reaches.

    Each round every node adopts its smallest neighbour, follows that twice, and the edges shrink
    to edges between the adopted nodes; the number of rounds grows with the logarithm of the
    longest path.  Only keys move, partially aggregated; a hub's edges are spread by the skew join.
    Every round is a written table.
    """
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "parents")
        up = first
        for _ in range(2):
            next_up = first.select(F.col("node").alias("__n"), F.col("up").alias("__u"))
            up = up.join(next_up, F.col("up") == F.col("__n")).select("node", F.col("__u").alias("up"))
        up = written(up, "parents")
        if labels is None:
            labels = up.select("node", F.col("up").alias("root"))
        else:
            moved = up.select(F.col("node").alias("__n"), "up")
            labels = written(labels.join(moved, F.col("root") == F.col("__n"), "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
        left, right = (up.select(F.col("node").alias(c), F.col("up").alias(f"__{c}")) for c in ("a", "b"))
        edges = written(edges.join(left, "a").join(right, "b").filter("__a <> __b")
                        .select(F.least("__a", "__b").alias("a"), F.greatest("__a", "__b").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels
