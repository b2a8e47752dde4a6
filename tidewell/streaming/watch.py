"""Watching: file streams into the engine, snapshots compared, bursts of changes as one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..engine import Engine, Input
from ..sources.files import probe_changes


def stream_into(spark: SparkSession, path: str, schema: str, engine: Engine, inp: Input, key: list[str], checkpoint: str):
    """Micro-batches of Parquet files in path upsert an input's rows by key; each batch is one revision at most.

    A batch that comes again after a failure names the same keys and rows, so it changes nothing: its effect is once.  Only the
    keys of a batch are compared and written.  Of several rows of a key in a batch, one stays: the greatest, column by column.
    """

    def batch(rows: DataFrame, number: int) -> None:
        columns = [c for c in rows.columns if c not in key]
        one = rows.groupBy(*key).agg(F.max(F.struct(*columns)).alias("_r")).select(*key, "_r.*").select(*rows.columns)
        engine.upsert(inp, one)

    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changes_to(engine: Engine, name: str, sink: Callable[[DataFrame, int], None]) -> Callable[[], None]:
    """Change feed out: sink(changed keys with decisions, revision) whenever a query's answer moves; returns the unsubscriber."""
    return engine.observe(name, lambda _, changes: sink(changes, engine.revision))


class Poller:
    """Polls snapshots (key, probe): what changed is handed on once nothing has changed for `quiet` polls; a consumer that raises
    gets the same changes again with the next ones."""

    def __init__(self, snapshot: Callable[[], DataFrame], consume: Callable[[set], None], quiet: int = 1):
        self.snapshot, self.consume, self.quiet = snapshot, consume, quiet
        self.last = _kept(snapshot())
        self.waiting: set = set()
        self.calm = 0

    def poll(self) -> bool:
        """One look; whether changes were handed on."""
        now = _kept(self.snapshot())
        moved = {k for k in {*now, *self.last} if now.get(k) != self.last.get(k)}
        self.last = now
        if moved:
            self.waiting |= moved
            self.calm = 0
            return False
        self.calm += 1
        if not self.waiting or self.calm < self.quiet:
            return False
        changes, self.waiting = self.waiting, set()
        try:
            self.consume(changes)
        except Exception:
            self.waiting |= changes
            raise
        return True


def _kept(snapshot: DataFrame) -> dict:
    """Keys and probes of a watched folder; its size is the number of watched files, which collect_files bounds."""
    return {r.key: r.probe for r in snapshot.select("key", "probe").toLocalIterator()}


def tumbling(events: DataFrame, at: str, width: str, by: list[str], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts a window and key, over a table or (with `late`) a stream; `slide` makes windows overlap."""
    e = events.withWatermark(at, late) if late else events
    return e.groupBy(F.window(at, width, slide) if slide else F.window(at, width), *by).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", *by, "n")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths that came, went or changed between two (key, probe) snapshots."""
    return probe_changes(old, new).where("state <> 'hit'")


def debounce(events: DataFrame, key: str, at: str, gap_seconds: int) -> DataFrame:
    """key, started, ended, n: runs of events of a key no two of which are more than the gap apart."""
    w = Window.partitionBy(key).orderBy(at)
    us = F.unix_micros(F.col(at).cast("timestamp"))
    starts = F.when(us - F.lag(us).over(w) <= gap_seconds * 1_000_000, 0).otherwise(1)
    runs = events.withColumn("_s", starts).withColumn("_run", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "_run").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("n")).drop("_run")


def debounced_stream(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """As debounce, on a stream: session windows behind a watermark."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count(F.lit(1)).alias("n"))
