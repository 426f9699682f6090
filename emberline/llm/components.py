"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations and two joins over all edges; nothing reaches the driver but one count
and one checksum per round. A hub's edges meet only in a partial minimum and in a join that adaptive
execution can split, so a node holding a third of all edges does not land in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.tables import kept


def _low(edges: DataFrame, whole: bool) -> DataFrame:
    """One star round: rewire each node's larger (or smaller) neighbours to its least neighbour."""
    if whole:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): root is the least node reachable. Nodes without an edge to another node are absent.

    Null ends and self loops are ignored, repeated edges count once, an empty table gives an empty one.
    """
    e = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"), (F.col(left) != F.col(right)).alias("proper"))
    e = kept(e.where("proper").select("a", "b").distinct())
    seen = None
    while True:
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        e = kept(_low(_low(e, True), False))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
