"""Reconciliation of desired outputs with a ledger of owned paths and with what is there."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import unicodedata
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ActionLockTimeoutError, ActionManifestError, ActionPathError
from ..sources.files import binary_files
from ..store import FileLock, replace_file


def classify(desired: DataFrame, ledger: DataFrame, actual: DataFrame) -> DataFrame:
    """path, outcome from (path, digest) relations: unchanged, created, repaired, updated, deleted, released or kept.

    One three-way full outer join on path; kept marks an owned path that someone else changed: it is left, the claim is dropped.
    """
    d, l, a = F.col("_d"), F.col("_l"), F.col("_a")
    joined = desired.select("path", F.col("digest").alias("_d")).join(ledger.select("path", F.col("digest").alias("_l")), "path", "full").join(actual.select("path", F.col("digest").alias("_a")), "path", "full")
    outcome = (
        F.when(d.isNotNull() & (a == d), "unchanged")
        .when(d.isNotNull() & a.isNull() & l.isNull(), "created")
        .when(d.isNotNull() & a.isNull(), "repaired")
        .when(d.isNotNull() & l.isNotNull() & (a != l), "repaired")
        .when(d.isNotNull(), "updated")
        .when(l.isNotNull() & (a == l), "deleted")
        .when(l.isNotNull() & a.isNotNull(), "kept")
        .when(l.isNotNull(), "released")
    )
    return joined.select("path", outcome.alias("outcome")).where("outcome is not null")


def path_conflicts(paths: DataFrame) -> DataFrame:
    """path, conflict for paths that can't be published: absolute, traversal, collisions of what other file systems take for one name
    (canonically equal or differing in case only: Unicode collation), a file where a folder must be."""
    p = F.col("path")
    bad = F.when(p.startswith("/") | p.rlike(r"^[A-Za-z]:"), "absolute").when(p.rlike(r"(^|/)\.{1,2}(/|$)") | (p == ""), "dots").when(p.contains("\\") | p.contains("\x00"), "character")
    single = paths.select("path", bad.alias("conflict"))
    fold = paths.select("path").distinct().withColumn("_k", F.collate(p, "UNICODE_CI"))
    collide = fold.groupBy("_k").agg(F.collect_set("path").alias("same")).where("size(same) > 1").select(F.explode("same").alias("path"), F.lit("collision").alias("conflict"))
    parents = paths.select(F.explode(F.expr("transform(sequence(1, greatest(1, size(split(path, '/')) - 1)), i -> array_join(slice(split(path, '/'), 1, i), '/'))")).alias("path"), F.col("path").alias("of")).where("path <> of")
    prefix = paths.join(parents.select("path").distinct(), "path", "left_semi").select("path", F.lit("folder").alias("conflict"))
    return single.where("conflict is not null").unionByName(collide).unionByName(prefix).distinct()


def digests(content: DataFrame) -> DataFrame:
    """(path, content binary) with its digest."""
    return content.withColumn("digest", F.sha2("content", 256))


@dataclass(frozen=True)
class Output:
    """One desired file."""

    path: str
    content: bytes

    @classmethod
    def text(cls, path: str, text: str) -> Output:
        return cls(path, text.encode())


def desired(spark: SparkSession, outputs: list[Output]) -> DataFrame:
    """The relation (path, content) of a few outputs made on the driver."""
    return spark.createDataFrame([(o.path, bytearray(o.content)) for o in outputs], "path string, content binary")


LEDGER_FORMAT = 1


class Action:
    """Converges a folder to a desired relation (path, content).

    The decisions are one plan and stay a table; files are written one partition at a time, each whole or not at all.  A lock file keeps
    two reconciliations apart.  Effects come in the order: delete orphans, prune emptied folders, publish, record.  The ledger of
    owned paths is a table of its own generation, named by a small manifest that is replaced at the end, so a crash leaves the
    former ledger; a run that changes nothing leaves it byte for byte.
    """

    def __init__(self, spark: SparkSession, name: str, root: str, timeout: float = 30.0):
        self.spark, self.name, self.root, self.timeout = spark, name, os.path.abspath(root), timeout
        self.state = os.path.join(self.root, f".{name}-ledger")

    def _ledger(self) -> DataFrame:
        empty = self.spark.createDataFrame([], "path string, digest string")
        try:
            with open(os.path.join(self.state, "manifest.json"), encoding="utf-8") as f:
                m = json.load(f)
        except FileNotFoundError:
            return empty
        except ValueError as e:
            raise ActionManifestError(self.state) from e
        if not isinstance(m, dict) or m.get("format") != LEDGER_FORMAT or not re.fullmatch(r"g[0-9a-f]{32}", str(m.get("table"))):
            raise ActionManifestError(self.state)
        return self.spark.read.schema("path string, digest string").parquet(f"file://{self.state}/{m['table']}")

    def _actual(self) -> DataFrame:
        if not os.path.isdir(self.root):
            return self.spark.createDataFrame([], "path string, digest string")
        found = binary_files(self.spark, self.root).where(~F.col("path").startswith(".")).select("path", "digest")
        # Spark's listing leaves out names that start with an underscore; those few are looked at here.
        hidden = []
        for folder, _, files in os.walk(self.root):
            for name in files:
                path = os.path.relpath(os.path.join(folder, name), self.root)
                parts = path.split(os.sep)
                if any(x.startswith("_") for x in parts) and not any(x.startswith(".") for x in parts):
                    with open(os.path.join(folder, name), "rb") as f:
                        hidden.append(("/".join(parts), hashlib.file_digest(f, "sha256").hexdigest()))
        return found.where(~F.col("path").rlike("(^|/)_")).unionByName(self.spark.createDataFrame(hidden, "path string, digest string"))

    def plan(self, desired: DataFrame) -> DataFrame:
        """The decisions, without any effect."""
        return classify(digests(desired).select("path", "digest"), self._ledger(), self._actual())

    def reconcile(self, desired: DataFrame) -> dict[str, list[str]]:
        """Converge, and return the paths by outcome (all but the unchanged of a large folder are what a caller reads)."""
        os.makedirs(self.state, exist_ok=True)
        with FileLock(os.path.join(self.state, "lock"), self.timeout, error=ActionLockTimeoutError):
            return self._converge(desired)

    def _converge(self, desired: DataFrame) -> dict[str, list[str]]:
        conflicts = path_conflicts(desired.select("path")).limit(5).collect()
        if conflicts:
            raise ActionPathError(", ".join(f"{r.path}: {r.conflict}" for r in conflicts))
        table = "g" + uuid.uuid4().hex
        want, work = digests(desired), f"file://{self.state}/{table}-plan"
        self.plan(desired).write.parquet(work)
        plan = self.spark.read.schema("path string, outcome string").parquet(work)
        result: dict[str, list[str]] = {}
        try:
            for r in plan.toLocalIterator():
                result.setdefault(r.outcome, []).append(r.path)
            for path in result.get("deleted", []):
                os.remove(os.path.join(self.root, path))
                self._prune(os.path.dirname(os.path.join(self.root, path)))
            for r in want.join(plan.where("outcome in ('created', 'repaired', 'updated')"), "path").toLocalIterator(prefetchPartitions=False):
                replace_file(os.path.join(self.root, unicodedata.normalize("NFC", r.path)), bytes(r.content))
            if set(result) - {"unchanged"} or not os.path.exists(os.path.join(self.state, "manifest.json")) or self._disowned(want):
                want.select("path", "digest").write.parquet(f"file://{self.state}/{table}")
                replace_file(os.path.join(self.state, "manifest.json"), json.dumps({"format": LEDGER_FORMAT, "table": table}).encode())
                for old in os.listdir(self.state):
                    if old.startswith("g") and old != table:
                        shutil.rmtree(os.path.join(self.state, old), ignore_errors=True)
        finally:
            shutil.rmtree(os.path.join(self.state, f"{table}-plan"), ignore_errors=True)
        return {k: sorted(v) for k, v in result.items()}

    def _disowned(self, want: DataFrame) -> bool:
        """Whether the ledger lacks a desired path, as when a file was there before it was wanted."""
        return not want.select("path", "digest").exceptAll(self._ledger()).isEmpty()

    def _prune(self, folder: str) -> None:
        while folder != self.root and not os.listdir(folder):
            os.rmdir(folder)
            folder = os.path.dirname(folder)
