"""Relational operators that the engine's analyses need beyond plain joins: ranges, as-of, nearest enclosing, set operations, rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, by: list[str], width: int) -> DataFrame:
    """points with the intervals [start, end) of the same `by` columns that hold them: an equality join on cells of `width`.

    An interval goes to each cell it touches, a point to one, so no pair is looked at that doesn't share a cell; choose the
    width near the usual length of intervals.  Column names of the two sides may clash only in `by`.
    """
    cell = lambda c: F.floor(c / width)
    p = points.withColumn("_cell", cell(F.col(at)))
    i = intervals.where(F.col(start) < F.col(end)).withColumn("_cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end) - 1))))
    return p.join(i, [*by, "_cell"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("_cell")


def innermost(joined: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Of the intervals that hold a point, the shortest; ties go to the one that starts last."""
    w = Window.partitionBy(*key).orderBy(F.col(end) - F.col(start), F.col(start).desc())
    return joined.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, since: str, values: list[str]) -> DataFrame:
    """left with the values of the latest right row of the same `by` columns whose `since` is at or before `at` (null: none).

    Both sides are sorted together once: an aggregate-free forward fill, instead of all pairs of a key.
    """
    v = F.struct(*values)
    l = left.select(*by, F.col(at).alias("_t"), F.lit(1).alias("_o"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(v.alias("v")).schema[0].dataType).alias("_v"))
    r = right.select(*by, F.col(since).alias("_t"), F.lit(0).alias("_o"), F.lit(None).cast(l.schema["_l"].dataType).alias("_l"), v.alias("_v"))
    w = Window.partitionBy(*by).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    filled = l.unionByName(r).withColumn("_f", F.last("_v", ignorenulls=True).over(w)).where("_o = 1")
    return filled.select("_l.*", *[F.col(f"_f.{c}").alias(c) for c in values])


def nearest_enclosing(uses: DataFrame, bindings: DataFrame, scopes: DataFrame, depth: int = 64) -> DataFrame:
    """uses (path, name, scope) with the scope that binds the name, going outward: found is null where none does.

    scopes (path, scope, parent, kind); class scopes are passed over except as the place of use.  One join a level, of the uses
    that are still open only.
    """
    b = bindings.select(F.col("path").alias("_bp"), F.col("name").alias("_bn"), F.col("scope").alias("_b")).distinct()
    s = scopes.select(F.col("path").alias("_sp"), F.col("scope").alias("_s"), F.col("parent").alias("_p"), F.col("kind").alias("_k"))
    open_, done = uses.withColumn("_at", F.col("scope")).withColumn("_first", F.lit(True)), None
    for _ in range(depth):
        here = open_.join(s, (F.col("path") == F.col("_sp")) & (F.col("_at") == F.col("_s")), "left")
        hit = here.join(b, (F.col("path") == F.col("_bp")) & (F.col("name") == F.col("_bn")) & (F.col("_at") == F.col("_b")) & (F.col("_first") | (F.col("_k") != "class")), "left")
        ended = hit.where(F.col("_b").isNotNull() | F.col("_p").isNull()).select(*uses.columns, F.col("_b").alias("found"))
        done = ended if done is None else done.unionByName(ended)
        open_ = hit.where(F.col("_b").isNull() & F.col("_p").isNotNull()).select(*uses.columns, F.col("_p").alias("_at"), F.lit(False).alias("_first"))
        if open_.isEmpty():
            break
    return done


def first_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row a key: the first in order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, once each."""
    return a.intersect(b)


def subtotals(rows: DataFrame, by: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates for every prefix of `by`, down to the grand total; level counts the columns that are totalled over."""
    return rows.rollup(*by).agg(*aggregates, F.grouping_id().alias("level"))


def above_own_mean(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows whose value exceeds the mean of their group: the correlated subquery, as one window."""
    return rows.withColumn("_m", F.avg(value).over(Window.partitionBy(*by))).where(F.col(value) > F.col("_m")).drop("_m")
