"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerwire.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest
    node of its component. Each round points every node at its smallest
    neighbour, follows the pointers twice and contracts the edges, so the
    number of rounds grows with the logarithm of a component's diameter.
    Nothing is collected; each round's tables are written and read again."""
    edges = cut(edges.select("a", "b").where("a <> b").distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root"))
        for _ in range(2):
            up = parent.select(F.col("node").alias("up"), F.col("root").alias("top"))
            parent = cut(parent.join(up, F.col("root") == F.col("up")).select("node", F.col("top").alias("root")), "parents")
        if roots is None:
            roots = parent
        else:   # nodes whose root was contracted again follow it
            up = parent.select(F.col("node").alias("up"), F.col("root").alias("top"))
            roots = cut(roots.join(up, F.col("root") == F.col("up"), "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
        at = lambda c, p: parent.select(F.col("node").alias(c), F.col("root").alias(p))
        edges = cut(edges.join(at("a", "ra"), "a").join(at("b", "rb"), "b").where("ra <> rb")
                    .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
