"""What the engine's logs say, as relations: profiles, counters, eviction, work done once a request, closed nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import table_of


def profile(timings: DataFrame, by: list[str], took: str, at: str) -> DataFrame:
    """count, total, mean (whole), least, most and last of timings by node; last is that of the greatest `at`."""
    t = F.col(took)
    return timings.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(t).alias("total"), F.min(t).alias("least"), F.max(t).alias("most"), F.max_by(t, F.col(at)).alias("last")).withColumn("mean", F.expr("total div n"))


def counters(log: DataFrame) -> DataFrame:
    """decision, n."""
    return log.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def evicted(touches: DataFrame, node: str, at: str, cap: int) -> DataFrame:
    """node, used, evicted: all but the `cap` nodes that were touched last; ties go to the smaller node.  A top-k, so nothing is ranked as a whole."""
    used = touches.groupBy(node).agg(F.max(at).alias("used"))
    stay = used.orderBy(F.col("used").desc(), node).limit(cap).select(F.col(node).alias("_n"), F.lit(False).alias("_e"))
    return used.join(stay, F.col(node).eqNullSafe(F.col("_n")), "left").select(node, "used", F.coalesce("_e", F.lit(True)).alias("evicted"))


def once(requests: DataFrame, request: str, call: list[str], at: str) -> DataFrame:
    """The first of equal calls in a request does the work: request, call, first, repeats."""
    return requests.groupBy(request, *call).agg(F.min(at).alias("first"), (F.count(F.lit(1)) - 1).alias("repeats"))


def closed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node of those that a checkpoint may hold: pure, and all they read current and closed.  Nodes (node, pure), edges (node, reads, current);
    what isn't closed spreads to its readers until none is added."""
    open_ = table_of(nodes.where(~F.col("pure")).select("node").union(edges.where(~F.col("current")).select("node")).distinct())
    size = open_.count()
    while True:
        more = edges.join(open_.select(F.col("node").alias("reads")), "reads", "left_semi").select("node")
        open_ = table_of(open_.union(more).distinct())
        now = open_.count()
        if now == size:
            return nodes.select("node").join(open_, "node", "left_anti")
        size = now
