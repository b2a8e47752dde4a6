"""Shared helpers: scratch tables in the cluster's shared folder, joins that survive hot keys."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that holds at least 1/HOT_PARTS of all rows is hot; so there are at most HOT_PARTS hot keys, whatever the size.
HOT_PARTS = 1000
_FALLBACK: dict[str, str] = {}
_ROOTS: dict[tuple[str, str], str] = {}
#: Tables that the open stage makes; None outside of stages.
_OPEN: list[list[str]] = []
#: Results of finished stages, while they live, and the tables that their plans read.
_STAGES: dict[str, list[tuple[weakref.ref, list[str]]]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.  Where that is unset, a temporary one in local mode (tests) and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _FALLBACK.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tidewell-"))


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the application's folder, which goes when the application ends."""
    app, shared = spark.sparkContext.applicationId, shared_dir(spark)
    if (app, shared) not in _ROOTS:
        root = f"{shared}/tidewell/{app}"
        p, fs = _hadoop(spark, root)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _ROOTS[app, shared] = root
    path = f"{_ROOTS[app, shared]}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def _reads(df: DataFrame) -> set[str]:
    """Root paths of the file relations in the plan of df."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), set()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            roots = leaf.relation().location().rootPaths()
            out.update(roots.apply(k).toString() for k in range(roots.size()))
    return out


@contextmanager
def stage(docs: DataFrame):
    """Owns the tables made inside.  Yields done(result), to be called with what the stage returns.

    On entry, tables of earlier stages go whose result no longer lives and that docs doesn't read; tables made outside of
    stages are never touched.
    """
    spark = docs.sparkSession
    app, held = spark.sparkContext.applicationId, {p.rsplit("/", 1)[-1] for p in _reads(docs)}
    still = []
    for result, paths in _STAGES.get(app, []):
        if result() is not None or any(p.rsplit("/", 1)[-1] in held for p in paths):
            still.append((result, paths))
            continue
        for path in paths:
            delete(spark, path)
    _STAGES[app] = still
    made: list[str] = []

    def done(result: DataFrame) -> DataFrame:
        _STAGES[app].append((weakref.ref(result), made))
        return result

    _OPEN.append(made)
    try:
        yield done
    finally:
        _OPEN.remove(made)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return the reread table: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, then=lambda df: df) -> DataFrame:
    """As cut, but bucketed and sorted by key, so that later joins on it don't exchange this side again.  `then` maps it after the exchange by key."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"tidewell_{name}_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    then(df.repartition(n, key)).write.bucketBy(n, key).sortBy(key).option("path", path).option("compression", "zstd").saveAsTable(table)
    found = spark.table(table)
    found.schema  # resolved: the plan knows the buckets from here on, and the name is needed no more
    spark.sql(f"DROP TABLE {table}")
    return found


def free_shuffles(spark: SparkSession) -> None:
    """Drop this process's references to finished plans, and let Spark's cleaner see it: shuffle files of finished phases go when the JVM notices."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def salted(rows: DataFrame, groups: DataFrame, key: list[str], count: str, total: int, spread: Column) -> tuple[DataFrame, DataFrame]:
    """rows and one-row-per-key groups, both with a part _tw_s beside the key, so that no key's rows need meet in one task.

    A key with count >= total / HOT_PARTS rows is cut into parts by `spread`, and its group row is repeated for each; such keys
    are at most HOT_PARTS in number, and what is broadcast is their hash and number of parts, 12 bytes a key.  Rows with a null
    key are spread too.
    """
    least = max(2, -(-total // HOT_PARTS))
    h = F.xxhash64(*[F.col(k) for k in key])
    parts = F.ceil(F.col(count) / least).cast("int")
    hot = F.broadcast(groups.where(F.col(count) > least).select(h.alias("_tw_h"), parts.alias("_tw_n")).groupBy("_tw_h").agg(F.max("_tw_n").alias("_tw_n")))
    empty = F.greatest(*[F.col(k).isNull() for k in key]) if len(key) > 1 else F.col(key[0]).isNull()
    part = F.when(empty, F.pmod(spread, F.lit(2**30))).when(F.col("_tw_n").isNull(), F.lit(0)).otherwise(F.pmod(spread, F.col("_tw_n"))).cast("long")
    left = rows.withColumn("_tw_h", h).join(hot, "_tw_h", "left").withColumn("_tw_s", part).drop("_tw_h", "_tw_n")
    every = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_tw_n"), F.lit(1)).cast("long") - 1)
    return left, groups.withColumn("_tw_h", h).join(hot, "_tw_h", "left").withColumn("_tw_s", F.explode(every)).drop("_tw_h", "_tw_n")


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], count: str, total: int, spread: Column) -> DataFrame:
    """Left join of rows with one-row-per-key groups, safe for keys that hold any share of the rows (see salted).

    groups has the key columns, `count` (rows with that key) and value columns.  `count` stays as a column; null keys match nothing.
    """
    values = [c for c in groups.columns if c not in key]
    left, right = salted(rows, groups, key, count, total, spread)
    right = right.select(*[F.col(k).alias(f"_tw_k{i}") for i, k in enumerate(key)], F.col("_tw_s").alias("_tw_p"), F.struct(*values).alias("_tw_v"))
    on = [F.col(k) == F.col(f"_tw_k{i}") for i, k in enumerate(key)] + [F.col("_tw_s") == F.col("_tw_p")]
    return left.join(right, on, "left").select(*rows.columns, *[F.col("_tw_v")[v].alias(v) for v in values])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
