"""Operator 7, mixing sources to target weights: cube-method balanced sampling.

Every document of a source has the same expected number of copies r = target / source_size, 0 to 3.  floor(r) copies are
certain; the fraction is an inclusion probability.  The flight phase moves the fractions of small sets of documents
through the null space of two constraints (document total, word total) until one of the set is 0 or 1.  Flights run in
blocks of a source in parallel; what is left of each block (at most two documents) flies again with the rest of its
source, level by level, until one block a source remains.  A ladder of twelve documents of halving sizes, chosen from the
whole source before the first level, stays out of all flights; with the two that the last flight leaves they are the landing
problem: of their 2^14 roundings, the one nearest to the word total wins.  Each source lands at its own last level.

Defined cases: null text has size 0; documents of size 0 follow the document total only.  Null source is a source of its
own, last in order.  A source of size 0 has target 0.  Repeated rows are units of their own.  An empty table gives an
empty result.  Very long texts are units like others.  Ties in a landing go to the first rounding.  Blocks, order and random
numbers depend on the rows alone, so reruns agree.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .batches import slices
from .common import cut, join_groups, table
from .words import Words

#: Fractional documents a flight block holds on average.
BLOCK = 20_000
#: Units kept from the flight for the landing, beside the two it leaves.
LANDING = 12
_EPS = 1e-9


def flight(p: list[float], size: list[float], rng: np.random.Generator, order: list[int]) -> list[int]:
    """Fly the units in `order`, changing p in place; returns those (at most two) that are still between 0 and 1."""
    draws = iter(rng.random(len(order)).tolist())
    active: list[int] = []
    for nxt in order:
        active.append(nxt)
        if len(active) < 3:
            continue
        a, b, c = (size[i] for i in active)
        u = (b - c, c - a, a - b)  # spans the null space of the rows (1, 1, 1) and (a, b, c)
        scale = max(map(abs, u))
        u = tuple(x / scale for x in u) if scale else (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(active, u) if x)
        down = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in zip(active, u) if x)
        step = up if next(draws) * (up + down) < down else -down
        left = []
        for i, x in zip(active, u):
            now = p[i] + x * step
            p[i] = 0.0 if now <= _EPS else 1.0 if now >= 1 - _EPS else now
            if 0.0 < p[i] < 1.0:
                left.append(i)
        active = left
        if len(active) == 3:  # rounding kept all three inside: settle the nearest
            i = min(active, key=lambda j: min(p[j], 1 - p[j]))
            p[i] = float(round(p[i]))
            active.remove(i)
    return active


def ladder(size: list[float], n: int = LANDING) -> list[int]:
    """Units whose sizes halve from the largest downward; kept for the landing, where their sums reach almost any total."""
    s = np.asarray(size, dtype=float)
    rest, out = np.lexsort((np.arange(len(s)), -s)), []
    want = s[rest[0]] if len(rest) else 0
    while len(rest) and len(out) < n and want >= 0.5:
        at = int(np.abs(s[rest] - want).argmin())
        out.append(int(rest[at]))
        rest = np.delete(rest, at)
        want /= 2
    return out


def _rungs(source: pd.DataFrame) -> pd.DataFrame:
    """Rows (skey, size, n_size) of a source -> (skey, size, n_size, take) of the sizes its ladder takes.  Units of a source differ by size only."""
    source = source.sort_values("size", ascending=False, ignore_index=True)
    at = np.repeat(np.arange(len(source)), np.minimum(source["n_size"], LANDING))
    take = np.bincount(at[ladder(source["size"].to_numpy()[at])], minlength=len(source))
    return source.assign(take=take)[take > 0]


def with_ladder(flying: DataFrame, total: int) -> DataFrame:
    """Adds _tw_kept: the unit belongs to the ladder of its source."""
    counts = flying.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n_size"))
    rungs = cut(counts.groupBy("skey").applyInPandas(_rungs, "skey string, size long, n_size long, take long"), "rungs")
    on = join_groups(flying.select("skey", "size", "_tw_r", "_tw_u"), rungs, ["skey", "size"], "n_size", total, F.col("_tw_r")).where("take is not null")
    # The literal bound lets Spark drop most of a frequent size before the exchange.
    on = on.withColumn("_tw_n", F.row_number().over(Window.partitionBy("skey", "size").orderBy("_tw_r", "_tw_u"))).where(F.col("_tw_n") <= LANDING)
    kept = cut(on.where("_tw_n <= take").select("_tw_u", F.lit(True).alias("_tw_kept")), "ladder")
    return flying.join(kept, "_tw_u", "left").withColumn("_tw_kept", F.coalesce("_tw_kept", F.lit(False)))


def landing(p: list[float], size: list[float], left: list[int]) -> None:
    """Round the units left, in place: the rounding nearest to their word total wins, then the one nearest to their document total."""
    bits = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    q, s = np.array([p[i] for i in left]), np.array([size[i] for i in left])
    cost = np.abs(bits @ s - q @ s) + np.abs(bits.sum(1) - q.sum())
    for i, x in zip(left, bits[int(cost.argmin())]):
        p[i] = float(x)


def _fly(block: pd.DataFrame) -> pd.DataFrame:
    """Units of the ladder pass; they land with the last block of their source."""
    block = block.sort_values(["_tw_r", "_tw_u"], kind="stable")
    size, p = block["size"].astype(float).tolist(), block["p"].tolist()
    source = block["source"].iloc[0]
    rng = np.random.default_rng(zlib.crc32(repr((None if pd.isna(source) else source, int(block["_tw_b"].iloc[0]))).encode()))
    kept, rest = np.flatnonzero(block["_tw_kept"]).tolist(), np.flatnonzero(~block["_tw_kept"]).tolist()
    left = flight(p, size, rng, rest)
    if block["_tw_blocks"].iloc[0] == 1:
        landing(p, size, kept + left)
    return block.assign(p=p)


def text_hash():
    """64 bits of the text, null as the empty one; tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash, size: words [^\\x20\\x09-\\x0D]+ of the whole text."""
    ship(docs.sparkSession)

    def count(batches):
        for batch in batches:
            for b in slices(batch, 3):
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(Words(b.column(3)).counts, pa.int64())], ["doc_id", "source", "text_hash", "size"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, source string, text_hash long, size long")


def targets(per_source: DataFrame, weights: int = 3, ceiling: int = 3) -> DataFrame:
    """Adds target and rate to (source, source_size, n_docs): weights 1, 2, 3, 1, ... by source order; water-filling under ceiling * size.

    Works on one row a source, so its windows over all rows hold sources only.
    """
    every = Window.partitionBy(F.lit(0))
    ranked = per_source.withColumn("_w", (F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1) % weights + 1)
    ranked = ranked.withColumn("_cap", F.col("source_size") * ceiling).withColumn("_at", F.col("_cap") / F.col("_w"))
    by = every.orderBy("_at", F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("_lambda", (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))))
    # Sources in order of cap / weight: the first whose cap exceeds its share fixes the level for itself and all after it.
    ranked = ranked.withColumn("_level", F.first(F.when(F.col("_at") >= F.col("_lambda"), F.col("_lambda")), ignorenulls=True).over(every.orderBy("_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_level"), F.lit(float("inf"))) * F.col("_w"))
    return ranked.withColumn("target", target).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))).select("source", "source_size", "n_docs", "target", "rate")


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target, copies (long), taken = size * copies; a row for every row of docs."""
    spark = docs.sparkSession
    rows = cut(sizes(docs), "sizes")
    total = rows.count()
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    per = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))).withColumn("skey", key), "targets")
    spread = F.xxhash64(F.col("doc_id"), F.col("size"))
    both = join_groups(rows.withColumn("skey", key), per.drop("source"), ["skey"], "n_docs", total, spread)
    both = both.withColumn("base", F.floor(F.col("rate") + _EPS)).withColumn("p0", F.greatest(F.lit(0.0), F.col("rate") - F.col("base")))
    both = cut(both.withColumn("_tw_r", F.xxhash64(F.lit(7), F.col("doc_id"), F.col("size"))).withColumn("_tw_u", F.monotonically_increasing_id()), "units")
    ship(spark)
    flying = both.where(F.col("p0") > _EPS).select("skey", "source", "_tw_u", "_tw_r", "size", "n_docs", "p0", F.col("p0").alias("p"))
    flying = with_ladder(flying, total)
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block)).cast("long")
    done, level = [], 0
    most = per.agg(F.max("n_docs")).first()[0] or 0
    schema = "skey string, source string, _tw_u long, _tw_r long, size long, n_docs long, p0 double, p double, _tw_kept boolean, _tw_blocks long, _tw_b long"
    while True:
        flying = flying.withColumn("_tw_blocks", blocks).withColumn("_tw_b", F.pmod(F.xxhash64(F.lit(level), F.col("_tw_r")), F.col("_tw_blocks")))
        flown = cut(flying.groupBy("skey", "_tw_b").applyInPandas(_fly, schema), f"flight{level}")
        done.append(flown.where(F.col("p").isin(0.0, 1.0)).select("_tw_u", F.col("p").cast("long").alias("extra")))
        if most <= block:
            break
        # At most two documents a block are left, beside the ladder.
        flying = flown.where(~F.col("p").isin(0.0, 1.0)).withColumn("n_docs", 2 * F.col("_tw_blocks")).drop("_tw_b", "_tw_blocks")
        most, level = 2 * -(-most // block), level + 1
    extra = done[0]
    for d in done[1:]:
        extra = extra.unionByName(d)
    out = both.join(extra, "_tw_u", "left").withColumn("copies", F.col("base") + F.coalesce("extra", F.lit(0)))
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def op7_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the targets of their sources."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


SQL: dict[str, str] = {}
