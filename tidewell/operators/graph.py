"""Dependency graphs as edge relations (src depends on dst)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .memo import null_safe


#: Rows of a table that a join sends to every task, and edges that one task looks through by itself.
SENT, SMALL = 500_000, 100_000


def closure(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """src, dst for every path: doubling until no pair is added, so rounds are logarithmic in the longest path.  With `depth`, stops
    once paths of so many edges are in.  Each round is a table in the shared folder, so plans don't grow and a lost executor
    costs nothing.

    A pair is found once, with the length of its shortest path: a shortest path longer than `hops` edges begins with one of
    just `hops`, so only the pairs of that length go on, and they meet only the pairs that start where they end.
    """
    reach = fresh = table_of(edges.select("src", "dst").distinct().withColumn("_d", F.lit(1)))
    hops = 1
    while depth is None or hops < depth:
        first = fresh.where(F.col("_d") == hops).select(F.col("src").alias("_s"), F.col("dst").alias("src"))
        ahead, n = _sent(reach.join(_sent(first.select("src").distinct())[0], "src", "left_semi"))
        if not n:
            break
        step = first.join(ahead, "src").groupBy(F.col("_s").alias("src"), "dst").agg((F.min("_d") + hops).alias("_d"))
        ends = reach if n > SENT else _sent(reach.join(_sent(ahead.select("dst").distinct())[0], "dst", "left_semi"))[0]
        fresh = table_of(null_safe(step, ends, ["src", "dst"], "left_anti"))
        reach, hops = reach.unionByName(fresh), hops * 2
    return reach.select("src", "dst")


def _sent(df: DataFrame) -> tuple[DataFrame, int]:
    """df as a table, to be broadcast where it is small, and its number of rows."""
    df = table_of(df)
    n = df.count()
    return F.broadcast(df) if n <= SENT else df, n


def table_of(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again; the files go when the application ends."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = _LOCAL.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tidewell-tables-"))
    path = f"{shared.rstrip('/')}/tidewell-rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)


_LOCAL: dict[str, str] = {}


def cycle_members(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """Nodes that reach themselves; with `depth`, by paths as in closure.

    No pair of nodes is made.  Nodes that nothing leads to or that lead nowhere go, round by round; then each node takes the
    greatest node that reaches it as its colour, and of a colour those that reach that node are members.  Edges between colours
    and at members go, and the rest starts again; once it is SMALL, one task looks through it.  Rounds follow the longest path
    as long as more than SMALL edges are left.
    """
    if depth is not None:
        return closure(edges, depth).where("src = dst").select(F.col("src").alias("node")).distinct()
    e = table_of(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    found = [e.where("src = dst").select(F.col("src").alias("node"))]
    e, n = e.where("src <> dst"), -1
    while (now := e.count()) > SMALL:
        if now != n:
            into, out = e.select(F.col("dst").alias("src")).distinct(), e.select(F.col("src").alias("dst")).distinct()
            e, n = table_of(e.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst")), now
            continue
        colour = _colours(e).select("node", "colour")
        both = e.join(colour.select(F.col("node").alias("src"), "colour"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("_c")), "dst")
        e = table_of(both.where("colour = _c").select("src", "dst", "colour"))
        at = reached = table_of(e.where("dst = colour").select(F.col("src").alias("node")).distinct())
        while not at.isEmpty():
            before = e.join(at.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
            at = table_of(before.join(reached, "node", "left_anti"))
            reached = reached.unionByName(at)
        reached = table_of(reached)
        found.append(reached)
        for c in ("src", "dst"):
            e = e.join(reached.select(F.col("node").alias(c)), c, "left_anti")
        e, n = table_of(e.select("src", "dst")), -1
    if now:
        ship(e.sparkSession)
        node = T.StructType([T.StructField("node", e.schema["src"].dataType)])
        found.append(e.coalesce(1).mapInArrow(_on_cycles, node))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.distinct()


def _colours(e: DataFrame) -> DataFrame:
    """node, colour: the greatest node that reaches it, itself included.  Only nodes whose colour has changed tell it on."""
    state = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().select("node", F.col("node").alias("colour"), F.lit(True).alias("moved"))
    state = table_of(state)
    while not (told := state.where("moved")).isEmpty():
        offer = told.select(F.col("node").alias("src"), "colour").join(e, "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("_o"))
        better = F.coalesce(F.col("_o") > F.col("colour"), F.lit(False))
        state = table_of(state.join(offer, "node", "left").select("node", F.when(better, F.col("_o")).otherwise(F.col("colour")).alias("colour"), better.alias("moved")))
    return state


def _on_cycles(batches):
    """The nodes of the edges in all batches that lie on a cycle: Tarjan's components of more than one node, without recursion."""
    import pyarrow as pa

    after, kind = {}, None
    for b in batches:
        kind = b.column(0).type
        for s, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            after.setdefault(s, []).append(d)
    number, low, open_, stack, out = {}, {}, set(), [], []
    for root in after:
        if root in number:
            continue
        walk = [(root, iter(after[root]))]
        number[root] = low[root] = len(number)
        stack.append(root)
        open_.add(root)
        while walk:
            v, rest = walk[-1]
            for w in rest:
                if w not in number:
                    number[w] = low[w] = len(number)
                    stack.append(w)
                    open_.add(w)
                    walk.append((w, iter(after.get(w, ()))))
                    break
                if w in open_:
                    low[v] = min(low[v], number[w])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
                if low[v] == number[v]:
                    at = len(stack) - 1
                    while stack[at] != v:
                        at -= 1
                    if len(stack) - at > 1:
                        out += stack[at:]
                    open_.difference_update(stack[at:])
                    del stack[at:]
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, kind)], ["node"])


def labels(edges: DataFrame) -> DataFrame:
    """src, dependencies: the sorted labels it depends on, comma-joined."""
    return edges.groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("dependencies"))


def first_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row a key: the first in order."""
    from pyspark.sql import Window

    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def follow(aliases: DataFrame, hops: int = 8) -> DataFrame:
    """name, target, hops, outcome from (name, next): next is null at a definition.  A chain longer than `hops`, or one that comes
    back, is ambiguous; a name nobody defines is missing."""
    a = aliases.select(F.col("name").alias("_n"), F.col("next").alias("_x"))
    at = aliases.select("name", F.col("name").alias("target"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("outcome"))
    for _ in range(hops + 1):
        j = at.join(a, F.col("target") == F.col("_n"), "left")
        ended = F.col("outcome").isNotNull()
        outcome = F.when(ended, F.col("outcome")).when(F.col("_n").isNull(), "missing").when(F.col("_x").isNull(), "workspace").when(F.col("hops") >= hops, "ambiguous")
        at = j.select("name", F.when(outcome.isNull(), F.col("_x")).otherwise(F.col("target")).alias("target"), F.when(outcome.isNull(), F.col("hops") + 1).otherwise(F.col("hops")).alias("hops"), outcome.alias("outcome"))
    return at.withColumn("outcome", F.coalesce("outcome", F.lit("ambiguous")))


def flatten_classes(bases: DataFrame, members: DataFrame, depth: int = 8) -> DataFrame:
    """class, member, definer, depth from bases (class, base, pos) and members (class, member): the shallowest definer wins, then
    the one reached first from left to right."""
    reach = members.select("class").union(bases.select("class")).union(bases.select("base")).distinct().select("class", F.col("class").alias("at"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("path"))
    every = reach
    for d in range(1, depth):
        reach = table_of(reach.join(bases.select(F.col("class").alias("at"), "base", "pos"), "at").select("class", F.col("base").alias("at"), F.lit(d).alias("depth"), F.concat("path", F.array(F.col("pos").cast("int"))).alias("path")))
        if reach.isEmpty():
            break
        every = every.unionByName(reach)
    found = every.join(members.select(F.col("class").alias("at"), "member"), "at")
    return first_wins(found, ["class", "member"], ["depth", "path"]).select("class", "member", F.col("at").alias("definer"), "depth")
