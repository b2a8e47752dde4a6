"""A small language of integer bindings over several files: `include "f"`, `let n = a + 3 - b`, `emit n`, `# comment`."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import cycle_members, table_of
from ..operators.joins import first_wins

_LET = r"^let\s+([A-Za-z_]\w*)\s*=\s*(.+)$"
_TERMS = r"^[+-]?\s*\w+(\s*[+-]\s*\w+)*$"


def lines(files: DataFrame) -> DataFrame:
    """file, number, kind (include, let, emit or invalid), name, expression of (path, text); all in the JVM."""
    raw = files.select(F.col("path").alias("file"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("number", "raw"))
    line = raw.withColumn("line", F.trim(F.regexp_replace("raw", "#.*$", ""))).where("line <> ''")
    include, emit = F.regexp_extract("line", r'^include\s+"([^"]+)"$', 1), F.regexp_extract("line", r"^emit\s+([A-Za-z_]\w*)$", 1)
    name, expression = F.regexp_extract("line", _LET, 1), F.trim(F.regexp_extract("line", _LET, 2))
    kind = F.when(include != "", "include").when(emit != "", "emit").when((name != "") & expression.rlike(_TERMS), "let").otherwise("invalid")
    return line.select("file", "number", kind.alias("kind"), F.when(include != "", include).when(emit != "", emit).when(name != "", name).alias("name"), F.when(name != "", expression).alias("expression"))


def reading_order(parsed: DataFrame, root: str, depth: int = 64) -> DataFrame:
    """file, rank: files that root reaches by includes, nearest first, each at its nearest place."""
    spark = parsed.sparkSession
    edges = parsed.where("kind = 'include'").select("file", F.col("name").alias("target"), "number")
    at, every = spark.createDataFrame([(root, [0])], "file string, place array<int>"), None
    for _ in range(depth):
        every = at if every is None else every.unionByName(at)
        step = at.join(edges, "file").select(F.col("target").alias("file"), F.array_append("place", F.col("number").cast("int")).alias("place"))
        at = first_wins(step.join(every.select("file").distinct(), "file", "left_anti"), ["file"], ["place"])
        if at.isEmpty():
            break
    return every.select("file", F.size("place").alias("depth"), "place")


def bindings(parsed: DataFrame, root: str) -> DataFrame:
    """name, expression, file: the first binding of a name in reading order wins."""
    order = reading_order(parsed, root)
    return first_wins(parsed.where("kind = 'let'").join(order, "file"), ["name"], ["depth", "place", "number"]).select("name", "expression", "file")


def terms(table: DataFrame) -> DataFrame:
    """name, sign, ref (null for a number), value of each term."""
    signed = F.regexp_replace(F.regexp_replace("expression", r"\s+", ""), r"(?<!^)([+-])", ",$1")
    one = table.select("name", F.explode(F.split(signed, ",")).alias("term"))
    word = F.regexp_replace("term", r"^[+-]", "")
    number = word.try_cast("long")
    return one.select("name", F.when(F.col("term").startswith("-"), -1).otherwise(1).cast("long").alias("sign"), F.when(number.isNull(), word).alias("ref"), number.alias("value"))


def cycles(table: DataFrame) -> DataFrame:
    """name of bindings that reach themselves."""
    return cycle_members(terms(table).where("ref is not null").select(F.col("name").alias("src"), F.col("ref").alias("dst"))).withColumnRenamed("node", "name")


def evaluate(table: DataFrame, depth: int = 1_000_000) -> DataFrame:
    """name, value, problem of every binding.  Names whose terms are all known get their value, round by round; what is left when no name
    is added refers to a cycle or to a missing name.

    A round takes only the names found in the one before to the references that are still open; cycles are looked for among
    what is left open at the end.
    """
    t = table_of(terms(table))
    refs = t.where("ref is not null").select("name", "sign", "ref")
    state = table_of(t.groupBy("name").agg(F.coalesce(F.sum(F.col("sign") * F.col("value")), F.lit(0)).alias("value"), F.count("ref").alias("open")))
    known = [state.where("open = 0").select("name", "value")]
    for _ in range(depth - 1):
        fresh, left = state.agg(F.count(F.when(F.col("open") == 0, 1)), F.count(F.when(F.col("open") > 0, 1))).first()
        if not fresh or not left:
            break
        met = table_of(refs.join(state.where("open = 0").select(F.col("name").alias("ref"), F.col("value").alias("_v")), "ref", "left"))
        hits = met.where("_v is not null").groupBy("name").agg(F.sum(F.col("sign") * F.col("_v")).alias("_add"), F.count(F.lit(1)).alias("_met"))
        refs = met.where("_v is null").select("name", "sign", "ref")
        more = state.where("open > 0").join(hits, "name", "left")
        state = table_of(more.select("name", (F.col("value") + F.coalesce("_add", F.lit(0))).alias("value"), (F.col("open") - F.coalesce("_met", F.lit(0))).alias("open")))
        known.append(state.where("open = 0").select("name", "value"))
        if len(known) == 32:
            known = [table_of(_union(known))]
    ring = cycle_members(refs.select(F.col("name").alias("src"), F.col("ref").alias("dst"))).select(F.col("node").alias("name"), F.lit("cycle").alias("_ring"))
    out = table.select("name").join(_union(known), "name", "left").join(ring, "name", "left")
    return out.select("name", "value", F.when(F.col("value").isNull(), F.coalesce("_ring", F.lit("unresolved"))).alias("problem"))


def _union(tables: list[DataFrame]) -> DataFrame:
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    return every


def emitted(parsed: DataFrame, root: str) -> DataFrame:
    """path, content of the outputs: one text a name that root emits."""
    values = evaluate(bindings(parsed, root))
    names = parsed.where((F.col("kind") == "emit") & (F.col("file") == root)).select("name").distinct()
    return names.join(values, "name").where("value is not null").select(F.concat("name", F.lit(".txt")).alias("path"), F.encode(F.concat(F.col("value").cast("string"), F.lit("\n")), "UTF-8").alias("content"))


def valid_name(name: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z_]\w*", name))
