"""Operator 10, exact dedup: a persistent digest index, bucketed and sorted by hash.

New data is deduplicated by sort-merge anti-join against the index and appended.

Each batch adds a generation: (digest, keep_id, group_size, fresh) of its groups, where fresh says that no earlier
generation had the digest.  The anti-join reads the fresh rows of each generation; totals() sums all rows of a digest.  A
manifest, numbered and written once, names the generations that count, so a crash at any point leaves the index as it was
before or as it is after: files that no manifest names are never read.  A manifest number can be taken once; a writer that
comes second reads the newer manifest, and judges its batch again.  COMPACT generations are merged into one before the next is added; tables
read from the old ones before that must not be used any more.

Defined cases: null text counts as the empty text.  Rows with a null doc_id take part in group_size and stay only if no
row of their group has an id.  Two rows with the same id and text are both counted and both carry the same flags.  Very
long texts are digested whole.  An empty table gives an empty result and adds nothing.  Columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_groups, scratch_path, table


def digest(text):
    """SHA-256 of the whole text in UTF-8, lowercase hex; null as the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class DigestIndex:
    """Digests of everything taken in so far, in one folder of a shared file system.

    A generation is a Parquet table bucketed by digest with a fixed number of buckets and sorted within each, so an
    anti-join reads it without exchange or sort, and appending never rewrites earlier generations.
    """

    #: Generations beyond which an append merges them.
    COMPACT = 8

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self._number() < 0:
            self._commit(0, {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "generations": []})
        self.buckets = self._manifest()[1]["buckets"]

    def _number(self) -> int:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return -1
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json")), default=-1)

    def _manifest(self) -> tuple[int, dict]:
        n = self._number()
        stream = self._fs.open(self._path(f"{self.path}/manifests/{n:08d}.json"))
        try:
            return n, json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _commit(self, number: int, manifest: dict) -> bool:
        """Write a manifest under a number; False if that number is taken."""
        folder = f"{self.path}/manifests"
        self._fs.mkdirs(self._path(folder))
        whole, final = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{number:08d}.json")
        stream = self._fs.create(whole, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        try:
            lock = self._fs.createNewFile(self._path(f"{folder}/{number:08d}.taken"))
        except Py4JJavaError:
            lock = False
        if lock:
            lock = self._fs.rename(whole, final)
        else:
            self._fs.delete(whole, False)
        return lock

    def generations(self) -> list[str]:
        return self._manifest()[1]["generations"]

    def _open(self, generation: str) -> DataFrame:
        """A generation, with its buckets known to the plan; the catalog name is dropped as soon as it is resolved."""
        name = f"tidewell_gen_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({_COLUMNS}) USING parquet OPTIONS (path '{self.path}/gen/{generation}') CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS")
        found = self.spark.table(name)
        found.schema  # resolved
        self.spark.sql(f"DROP TABLE {name}")
        return found

    def unseen(self, groups: DataFrame, generations: list[str] | None = None) -> DataFrame:
        """The rows of groups whose digest no generation holds: one sort-merge anti-join a generation."""
        for g in self.generations() if generations is None else generations:
            groups = groups.join(self._open(g).where("fresh").select("digest").hint("merge"), "digest", "left_anti")
        return groups

    def _write(self, groups: DataFrame) -> str:
        generation, name = uuid.uuid4().hex, f"tidewell_gen_{uuid.uuid4().hex}"
        groups.select("digest", "keep_id", "group_size", "fresh").repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").option("path", f"{self.path}/gen/{generation}").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")
        return generation

    def append(self, groups: DataFrame) -> DataFrame:
        """Add groups (digest, keep_id, group_size); returns them with fresh: whether the digest is new to the index."""
        if len(self.generations()) >= self.COMPACT:
            self.compact()
        while True:
            number, manifest = self._manifest()
            new = self.unseen(groups.select("digest"), manifest["generations"]).withColumn("fresh", F.lit(True))
            judged = groups.join(new, "digest", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False))) if manifest["generations"] else groups.withColumn("fresh", F.lit(True))
            generation = self._write(judged)
            if self._commit(number + 1, manifest | {"generations": [*manifest["generations"], generation]}):
                break
            self._drop(generation)
        return self._open(generation)

    def totals(self) -> DataFrame:
        """digest, keep_id, group_size over everything taken in."""
        every = None
        for g in self.generations():
            own = self._open(g).select("digest", "keep_id", "group_size")
            every = own if every is None else every.unionByName(own)
        if every is None:
            return self.spark.createDataFrame([], "digest string, keep_id long, group_size long")
        # By the raw bytes, half as long: and Spark 4.1 takes a union of bucketed scans for partitioned by the bucket column, though its
        # columnar form isn't, so a key of its own also makes sure of the exchange.
        whole = every.groupBy(F.unhex("digest").alias("raw")).agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        return whole.select(F.lower(F.hex("raw")).alias("digest"), "keep_id", "group_size")

    def _drop(self, generation: str) -> None:
        self._fs.delete(self._path(f"{self.path}/gen/{generation}"), True)

    def compact(self) -> None:
        """Merge all generations into one: the merged one is written and named by a manifest before the old ones go."""
        number, manifest = self._manifest()
        if len(manifest["generations"]) < 2:
            return
        merged = self._write(self.totals().withColumn("fresh", F.lit(True)))
        if not self._commit(number + 1, manifest | {"generations": [merged]}):
            return self._drop(merged)
        for g in manifest["generations"]:
            self._drop(g)


_COLUMNS = "digest STRING, keep_id BIGINT, group_size BIGINT, fresh BOOLEAN"


def _digests(docs: DataFrame) -> DataFrame:
    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")), "digests")


def _take_in(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """Groups of the digests (digest, keep_id, group_size, fresh), after they are in the index."""
    return index.append(cut(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups"))


def ingest(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Judge every row of docs against the index and itself, and append what is new.

    Returns doc_id, keep_id, group_size, kept, text_sha256, seen_before.  Within the batch the row with the largest doc_id
    of equal texts stays; a text that the index already holds stays nowhere in this batch (kept false, seen_before true).
    """
    rows = _digests(docs)
    judged = cut(_take_in(rows, index), "judged")
    out = join_groups(rows, judged, ["digest"], "group_size", rows.count(), F.xxhash64("doc_id"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("fresh")).alias("kept"), F.col("digest").alias("text_sha256"), (~F.col("fresh")).alias("seen_before"))


def dedup(docs: DataFrame, index: DigestIndex, batches: int = 2) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, a row for every row of docs: docs goes through the index in batches, by a
    hash of the id, and each row is judged by the totals of the index at the end."""
    rows = _digests(docs)
    for b in range(batches):
        _take_in(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b), index)
    out = join_groups(rows, index.totals(), ["digest"], "group_size", rows.count(), F.xxhash64("doc_id"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in two batches, through a fresh index in the shared folder: the second is judged against the first."""
    return dedup(table(spark, sf_dir, "documents"), DigestIndex(spark, scratch_path(spark, "digest-index")))


SQL = {
    "op10_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, coalesce(d.doc_id = g.keep_id, d.doc_id IS NULL AND g.keep_id IS NULL) AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)""",
}
