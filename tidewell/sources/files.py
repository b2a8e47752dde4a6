"""External state as relations: cheap probes, and contents for the keys whose probe moved."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _relative(root: str):
    plain = os.path.abspath(root.removeprefix("file://"))
    return F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + plain.replace("\\", "\\\\").replace(".", "\\.") + "/", "")


def binary_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path (relative), content, digest, length, modified of every file under root."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select(_relative(root).alias("path"), "content", F.sha2("content", 256).alias("digest"), "length", F.col("modificationTime").alias("modified"))


def text_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path, text, decode_error: content that isn't UTF-8 reads as the empty text."""
    valid = F.is_valid_utf8(F.col("content"))
    return binary_files(spark, root, glob).select("path", F.when(valid, F.col("content").cast("string")).otherwise("").alias("text"), F.when(~valid, F.concat("path", F.lit(": utf-8 error"))).alias("decode_error"), "digest")


def file_stats(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modified; contents are pruned from the scan."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(_relative(root).alias("path"), "length", F.col("modificationTime").alias("modified"))


def directory(spark: SparkSession, root: str) -> DataFrame:
    """name, is_folder of a folder's entries, in order of names; no rows and no error if it is missing."""
    rows = sorted((e.name, e.is_dir()) for e in os.scandir(root)) if os.path.isdir(root) else []
    return spark.createDataFrame(rows, "name string, is_folder boolean")


def environment(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([(n, os.environ.get(n)) for n in names], "name string, value string")


def resolved_path(path: str) -> str | None:
    return os.path.realpath(path) if os.path.exists(path) else None


def stdlib_modules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in sorted(sys.stdlib_module_names)], "module string")


def probe_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """key, state from (key, probe) relations: hit, miss (probe moved), new, gone; failed where the new probe is null."""
    j = old.select("key", F.col("probe").alias("_o"), F.lit(True).alias("_ho")).join(new.select("key", F.col("probe").alias("_n"), F.lit(True).alias("_hn")), "key", "full")
    state = F.when(F.col("_hn").isNull(), "gone").when(F.col("_n").isNull(), "failed").when(F.col("_ho").isNull(), "new").when(F.col("_o").eqNullSafe(F.col("_n")), "hit").otherwise("miss")
    return j.select("key", state.alias("state"))


def overlay(base: DataFrame, over: DataFrame, key: str, value: str) -> DataFrame:
    """base with the rows of over in place of its own, and those it lacks."""
    j = base.select(key, F.col(value).alias("_b")).join(over.select(key, F.col(value).alias("_v")), key, "full")
    return j.select(key, F.coalesce("_v", "_b").alias(value))
