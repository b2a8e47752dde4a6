"""Set-at-a-time change propagation: differences between versions, dirty keys, backdating joins.  Keys join null-safe."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canon import row_digest, tagged

DIGEST = "_digest"
#: Hash columns of stored rows: two over all columns, two over those whose change counts; the latter only where these are fewer.
HASHES = ("_h1", "_h2", "_c1", "_c2")


def with_digest(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.withColumn(DIGEST, row_digest(df, columns))


def null_safe(left: DataFrame, right: DataFrame, key: list[str], how: str) -> DataFrame:
    """Semi or anti join on the key columns, null equal to null."""
    other = right.select(*[F.col(f"`{k}`").alias(f"_tw_{i}") for i, k in enumerate(key)])
    return left.join(other, [F.col(f"`{k}`").eqNullSafe(F.col(f"_tw_{i}")) for i, k in enumerate(key)], how)


def _hashable(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return c.cast("string")  # tells -0.0 from 0.0
    if isinstance(t, (T.MapType, T.ArrayType, T.StructType)):
        return tagged(c, t)
    return c


def _hashes(df: DataFrame, columns: list[str]) -> list[Column]:
    cols = [_hashable(F.col(f"`{c}`"), df.schema[c].dataType) for c in columns]
    # A hash skips nulls, so where they are is hashed too.
    nulls = F.concat(F.lit(""), *[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in columns])
    return [F.xxhash64(F.lit(seed), nulls, *cols) for seed in (1, 2)]


def hashed(df: DataFrame, compare: list[str] | None = None, key: list[str] | None = None) -> DataFrame:
    """df with HASHES; `compare` (with `key`) names the columns whose change counts, default all: then the first two do for both."""
    both = _hashes(df, df.columns)
    some = _hashes(df, [*(key or []), *compare]) if compare is not None else []
    return df.select("*", *[c.alias(n) for c, n in zip((*both, *some), HASHES)])


def moved_keys(old: DataFrame, new: DataFrame, key: list[str], eq: Callable | None = None, every: bool = False) -> DataFrame:
    """key, _moved of keys whose rows differ between two hashed tables; _moved says whether what counts differs.

    With every, all keys of both, with decision (new, executed, backdated, gone).  One aggregate over both sides, new rows
    counting plus and old ones minus: a key's rows are the same multiset if nothing is left, and null keys group like others.
    Rows are combined before the one exchange, of keys and sums only.
    """
    apart = set(HASHES) <= set(old.columns) & set(new.columns)
    sides = [t.select(*[F.col(f"`{k}`") for k in key], *(HASHES if apart else HASHES[:2]), F.lit(sign).cast("long").alias("_s")) for t, sign in ((old, -1), (new, 1))]
    low = lambda h: F.sum(F.col("_s") * F.col(h).bitwiseAND(F.lit(0xFFFFFFFF)))
    sums = lambda a, b, p: [F.bit_xor(a).alias(p + "x"), low(a).alias(p + "a"), low(b).alias(p + "b")]
    both = sides[0].unionByName(sides[1]).groupBy(*[F.col(f"`{k}`") for k in key]).agg(F.count(F.when(F.col("_s") < 0, 1)).alias("_old"), F.count(F.when(F.col("_s") > 0, 1)).alias("_new"), *sums("_h1", "_h2", "_h"), *(sums("_c1", "_c2", "_c") if apart else []))
    differs = lambda p: (F.col("_old") != F.col("_new")) | (F.col(p + "x") != 0) | (F.col(p + "a") != 0) | (F.col(p + "b") != 0)
    both = both.withColumn("_changed", differs("_h")).withColumn("_moved", differs("_c") if apart else F.col("_changed"))
    if eq is not None:
        both = _by_policy(both, old, new, key, eq)
    decision = F.when(F.col("_old") == 0, "new").when(F.col("_new") == 0, "gone").when(F.col("_moved"), "executed").otherwise("backdated")
    if every:
        return both.select(*key, decision.alias("decision"), "_changed", "_moved")
    return both.where("_changed").select(*key, "_moved")


def _by_policy(both: DataFrame, old: DataFrame, new: DataFrame, key: list[str], eq: Callable) -> DataFrame:
    """Keys of one row on either side that the policy calls equal haven't moved."""
    o = old.select(*[F.col(f"`{c}`").alias(f"_o_{c}") for c in old.columns if c not in HASHES])
    n = new.select(*[F.col(f"`{c}`").alias(f"_n_{c}") for c in new.columns if c not in HASHES])
    pairs = o.join(n, [F.col(f"_o_{k}").eqNullSafe(F.col(f"_n_{k}")) for k in key])
    same = eq(lambda c: F.col(f"_o_{c}"), lambda c: F.col(f"_n_{c}"))
    alike = pairs.where(same).groupBy(*[F.col(f"_n_{k}").alias(f"_e{i}") for i, k in enumerate(key)]).agg(F.lit(True).alias("_alike"))
    out = both.join(alike, [F.col(k).eqNullSafe(F.col(f"_e{i}")) for i, k in enumerate(key)], "left")
    single = (F.col("_old") == 1) & (F.col("_new") == 1)
    return out.withColumn("_moved", F.col("_moved") & ~F.coalesce(F.col("_alike") & single, F.lit(False))).drop("_alike", *[f"_e{i}" for i in range(len(key))])


def plan_probe(df: DataFrame):
    """What tells that a DataFrame gives the same rows as another one without running it: its canonical plan, and the path,
    length and time of the files it reads.  None where that can't be told: other sources than Parquet files, user code, a
    nondeterministic or streaming plan."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic() or plan.isStreaming():
        return None
    leaves, files = plan.collectLeaves(), []
    jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "LogicalRelation" or leaf.relation().getClass().getSimpleName() != "HadoopFsRelation" or leaf.relation().fileFormat().toString() != "Parquet":
            return None
        for f in sorted(leaf.relation().location().inputFiles()):
            p = jvm.org.apache.hadoop.fs.Path(f)
            status = p.getFileSystem(conf).getFileStatus(p)
            files.append((i, f, status.getLen(), status.getModificationTime()))
    text = plan.canonicalized().toString()
    if "..." in text or re.search(r"udf|python|arrow|pandas", text, re.I):
        return None  # shortened, or code that the text doesn't show
    return text, tuple(files)


def difference(old: DataFrame, new: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(minus, plus): rows of old and of new whose key differs in its multiset of rows."""
    moved = moved_keys(hashed(old), hashed(new), key).select(*key)
    return null_safe(old, moved, key, "left_semi"), null_safe(new, moved, key, "left_semi")


def multiset_difference(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As difference, for relations without a key: rows count by content."""
    return old.exceptAll(new), new.exceptAll(old)


def decide(old: DataFrame, new: DataFrame, dirty: DataFrame, key: list[str]) -> DataFrame:
    """key, decision for every key of old and dirty: executed, backdated, gone or reused.

    old and new have key and the digest; new holds the dirty keys' fresh rows only.
    """
    count = lambda t, p: t.groupBy(*key).agg(F.sort_array(F.collect_list(DIGEST)).alias(p)).withColumnsRenamed({k: f"{p}{i}" for i, k in enumerate(key)})
    o, n = count(old, "_o"), count(new, "_n")
    d = dirty.select(*key).distinct().withColumn("_d", F.lit(True))
    both = d.join(n, [F.col(k).eqNullSafe(F.col(f"_n{i}")) for i, k in enumerate(key)], "left").join(o, [F.col(k).eqNullSafe(F.col(f"_o{i}")) for i, k in enumerate(key)], "full")
    decision = F.when(F.col("_d").isNull(), "reused").when(F.col("_n").isNull() & F.col("_o").isNull(), "absent").when(F.col("_n").isNull(), "gone").when(F.col("_n").eqNullSafe(F.col("_o")), "backdated").otherwise("executed")
    keys = [F.when(F.col("_d").isNull(), F.col(f"_o{i}")).otherwise(F.col(k)).alias(k) for i, k in enumerate(key)]
    return both.select(*keys, decision.alias("decision")).where("decision <> 'absent'")


def merge(old: DataFrame, new: DataFrame, dirty: DataFrame, key: list[str]) -> DataFrame:
    """old with the dirty keys replaced by their fresh rows."""
    return null_safe(old, dirty, key, "left_anti").select(*new.columns).unionByName(new)
