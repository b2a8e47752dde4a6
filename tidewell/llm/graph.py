"""Connected components by contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a, b): root is the smallest vertex of its component.

    Each round hooks every vertex to its smallest neighbour, follows those pointers, and contracts the edges; at least half
    of the vertices that still have edges vanish a round, so rounds are logarithmic and stars take one.  Rounds are tables
    in the shared folder; the driver sees only whether edges are left.  A hub makes one key of a join's left side hot, whose
    right side has one row a key; Spark's adaptive skew join splits such a partition of the left side.
    """
    e = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = e.select(F.explode(F.array("a", "b")).alias("v")).distinct().select("v", F.col("v").alias("root"))
    rounds = 0
    while not e.isEmpty():
        up = e.select(F.col("b").alias("x"), F.col("a").alias("y")).unionByName(e.select(F.col("a").alias("x"), F.col("a").alias("y")))
        p = cut(up.groupBy("x").agg(F.min("y").alias("p")), "parents")
        for _ in range(2):
            q = p.select(F.col("x").alias("_x"), F.col("p").alias("_p"))
            p = p.join(q, F.col("p") == F.col("_x"), "left").select("x", F.coalesce("_p", "p").alias("p"))
        p = cut(p, "parents")
        q = p.select(F.col("x").alias("_x"), F.col("p").alias("_p"))
        labels = cut(labels.join(q, F.col("root") == F.col("_x"), "left").select("v", F.coalesce("_p", "root").alias("root")), "labels")
        e = e.join(q, F.col("a") == F.col("_x"), "left").select(F.coalesce("_p", "a").alias("a"), "b")
        e = e.join(q, F.col("b") == F.col("_x"), "left").select("a", F.coalesce("_p", "b").alias("b")).where("a <> b")
        e = cut(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        rounds += 1
    return labels
