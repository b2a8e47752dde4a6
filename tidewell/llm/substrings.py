"""Operator 5, substring dedup: relative Lempel-Ziv parsing against indexed reference blocks.

The reference is the corpus itself, read in order of doc_id and position.  Its index says where a window (WINDOW words)
starts earlier; it is cut into blocks by seed: a seed is the minimizer of a window (the least of its 15 hashes of 6
consecutive words), so equal windows, wherever they occur, have equal seeds and meet in one block.  A document is looked up
in every block that holds one of its seeds; the other blocks can't hold a window of it.  So every document is parsed
against the whole reference without meeting every block, which would be all pairs.

The parse is greedy from left to right: at a word whose window starts earlier, the factor takes its source from the index
and goes on as long as the index names the next place of the same source; its words are skipped, and the parse goes on
behind it.  A factor has WINDOW words at least.  At its end the windows that reach over the boundary are looked up one by
one, so a duplicate passage that runs over a boundary loses no word.  Words of factors and of boundary windows are the
duplicate spans.

Three phases keep what moves small, however the copies are spread:

1. Seeds (a seventh of the windows) meet their index block; those found once are done with.  Within a task only the first
   occurrence of a seed goes to the exchange, so a seed brings at most one row a task, however often it occurs.
2. Windows under repeated seeds meet their block, under 128-bit hashes, again one row a task each; all but the earliest are
   duplicates, and the earliest is their source.  A later occurrence in the same task is known to be one without any
   exchange, has the task's first as its source, and travels as a run.
3. Documents meet their duplicate runs, from one table bucketed by doc_id that both joins read without an exchange.

Texts that are equal word for word come first: every window of a later copy starts earlier in the first, so a copy is one
factor and never takes part.

Defined cases: null text has no words.  A text of fewer than WINDOW words loses nothing.  Very long texts are handled whole,
one at a time.  Rows with a null doc_id have no place in the order: they lose nothing and no other row loses words to them.
Rows that share a doc_id and text are copies of one another in an unspecified order: one of them stays.  Rows that share a
doc_id with different texts are documents of their own, in the order of a digest.  Columns other than doc_id and text are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .batches import slices
from .common import bucketed, cut, free_shuffles, join_groups, table
from .words import Words, windows

WINDOW = 20
SEED = 6
#: Rows a task gathers before it looks for repeats among them; memory follows it.
GATHER = 2_000_000


def seeds(h: np.ndarray, window: int = WINDOW, k: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Of word hashes: the seed hash of every position, and for each window the position of its seed (the leftmost least)."""
    g = windows(h, k)
    n, m = len(h) - window + 1, window - k + 1
    if n <= 0:
        return g, np.zeros(0, np.int64)
    best, at = g[:n].copy(), np.arange(n)
    for i in range(1, m):
        less = g[i : i + n] < best
        best[less] = g[i : i + n][less]
        at[less] = np.flatnonzero(less) + i
    return g, at


def long_windows(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each window, from two independent word hashes."""
    return windows(h1, WINDOW), windows(h2, WINDOW)


#: Positions carry above these bits which of the texts of a doc_id they belong to.
SHIFT = 32
_WITHIN = (1 << SHIFT) - 1


class _Firsts:
    """Gathers (key, doc, pos) and releases them so that of equal keys only the first goes to the exchange.

    Released rows: key columns, doc, pos, known, and doc and pos of the key's first here.  known 0: the first of its key, to
    be routed by key.  known 1: a later one, whose key occurs earlier in this task; it needs no exchange.
    """

    def __init__(self):
        self.parts: list[tuple] = []
        self.n = 0

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.parts.append(columns)
            self.n += len(columns[0])

    def release(self):
        if not self.n:
            return
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        self.parts, self.n = [], 0
        *keys, doc, pos = columns
        order = np.lexsort((pos, doc, *reversed(keys)))
        columns = [c[order] for c in columns]
        known = np.zeros(len(order), bool)
        same = np.ones(len(order) - 1, bool)
        for k in columns[: len(keys)]:
            same &= k[1:] == k[:-1]
        known[1:] = same
        first = np.maximum.accumulate(np.where(known, 0, np.arange(len(order))))
        yield (*columns, known, columns[-2][first], columns[-1][first])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _seed_rows(batches):
    """(doc_id, text, copy, nth) -> (seed, doc_id, pos, known): every seed of every document that isn't a copy."""
    gather = _Firsts()

    def out():
        for seed, doc, pos, known, *_ in gather.release():
            repeated = np.zeros(len(seed), bool)
            repeated[:-1] = known[1:]  # a first whose key occurs again is as repeated as the later ones
            yield pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(doc), pa.array(pos), pa.array(known), pa.array(repeated)], names=["seed", "doc_id", "pos", "known", "repeated"])

    for batch in batches:
        for b in slices(batch, 1):
            b = b.filter(pc.invert(b.column(2)))
            if not b.num_rows:
                continue
            w = Words(b.column(1))
            h, ids, nth = w.hashes(), b.column(0).to_numpy(), b.column(3).to_numpy()
            for i in range(b.num_rows):
                own = h[w.first[i] : w.first[i + 1]]
                if len(own) >= WINDOW:
                    g, at = seeds(own)
                    at = np.unique(at)
                    gather.add(g[at], np.full(len(at), ids[i]), at + (nth[i] << SHIFT))
            if gather.n > GATHER:
                yield from out()
    yield from out()


def _runs(doc: np.ndarray, pos: np.ndarray, from_doc: np.ndarray, from_pos: np.ndarray) -> pa.RecordBatch:
    """Windows with their sources as maximal runs (doc_id, pos, length, from_doc, from_pos) that go on in both places."""
    order = np.lexsort((pos, doc))
    doc, pos, from_doc, from_pos = doc[order], pos[order], from_doc[order], from_pos[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (from_doc[1:] != from_doc[:-1]) | (from_pos[1:] != from_pos[:-1] + 1)
    at = np.flatnonzero(new)
    length = np.diff(np.concatenate([at, [len(doc)]])).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(pos[at]), pa.array(length), pa.array(from_doc[at]), pa.array(from_pos[at])], names=["doc_id", "pos", "length", "from_doc", "from_pos"])


def _marked(batches, keys: int):
    """Columns of batches sorted by their first columns, and which rows have the key of the row before.  Streams: only the last key is carried."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        same = np.ones(b.num_rows, bool)
        for k in range(keys):
            same[1:] &= columns[k][1:] == columns[k][:-1]
            same[0] &= last is not None and columns[k][0] == last[k]
        last = tuple(c[-1] for c in columns[:keys])
        yield columns, same


def _repeated_seeds(batches):
    """Rows (known, seed, doc_id, pos, repeated) sorted so -> repeated seeds (doc_id, pos); a first is held back until its successor shows whether it is one."""
    held = None
    for columns, same in _marked(batches, 2):
        known, _, doc, pos, repeated = columns
        same &= ~known
        if held is not None and same[0]:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64())], names=["doc_id", "pos"])
        take = same | known | repeated
        take[:-1] |= same[1:]
        held = None if take[-1] else (doc[-1], pos[-1])
        yield pa.RecordBatch.from_arrays([pa.array(doc[take]), pa.array(pos[take])], names=["doc_id", "pos"])


def _window_rows(batches):
    """(doc_id, text, at: positions of repeated seeds, nth) -> windows under them; known ones as runs with length > 0."""
    gather = _Firsts()
    names = ["w1", "w2", "doc_id", "pos", "length", "from_doc", "from_pos"]

    def out():
        for a, b, doc, pos, known, from_doc, from_pos in gather.release():
            runs = _runs(doc[known], pos[known], from_doc[known], from_pos[known])
            zero = pa.array(np.zeros(runs.num_rows, np.int64))
            yield pa.RecordBatch.from_arrays([zero, zero, *runs.columns], names=names)
            free = ~known
            zero = pa.array(np.zeros(int(free.sum()), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a[free].view(np.int64)), pa.array(b[free].view(np.int64)), pa.array(doc[free]), pa.array(pos[free]), zero.cast(pa.int32()), zero, zero], names=names)

    for batch in batches:
        for b in slices(batch, 1):
            w = Words(b.column(1))
            h1, h2, ids = w.hashes(), w.hashes(1), b.column(0).to_numpy()
            found, nth = b.column(2).to_pylist(), b.column(3).to_numpy()
            for i in range(b.num_rows):
                s = slice(w.first[i], w.first[i + 1])
                if w.counts[i] < WINDOW:
                    continue
                _, at = seeds(h1[s])
                hit = np.zeros(int(w.counts[i]) + 1, bool)
                seen = np.array(found[i], np.int64)
                hit[seen[seen >> SHIFT == nth[i]] & _WITHIN] = True
                take = np.flatnonzero(hit[at])
                a, c = long_windows(h1[s], h2[s])
                gather.add(a[take], c[take], np.full(len(take), ids[i]), take + (nth[i] << SHIFT))
            if gather.n > GATHER:
                yield from out()
    yield from out()


def _duplicate_windows(batches):
    """Rows (w1, w2, doc_id, pos) sorted so -> runs of windows that start earlier elsewhere, with their sources."""
    kept, n, first = [], 0, (np.int64(0), np.int64(0))
    for columns, same in _marked(batches, 2):
        doc, pos = columns[2], columns[3]
        at = np.maximum.accumulate(np.where(same, -1, np.arange(len(same))))
        from_doc, from_pos = np.where(at < 0, first[0], doc[at]), np.where(at < 0, first[1], pos[at])
        first = (from_doc[-1], from_pos[-1])
        kept.append((doc[same], pos[same], from_doc[same], from_pos[same]))
        n += int(same.sum())
        if n > GATHER:
            yield _runs(*map(np.concatenate, zip(*kept)))
            kept, n = [], 0
    if n:
        yield _runs(*map(np.concatenate, zip(*kept)))


def parse(starts: np.ndarray, lengths: np.ndarray, from_doc: np.ndarray, from_pos: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, words, doc_id of the source, start there) of a document, from its runs of duplicate windows."""
    out: list[tuple[int, int, int, int]] = []
    end = last = 0  # the parse stands at word `end`; window `last` is the next that the open factor would take
    for i in np.argsort(starts).tolist():
        s, n, d, p = int(starts[i]), int(lengths[i]), int(from_doc[i]), int(from_pos[i])
        if out and s == last and out[-1][2] == d and out[-1][3] + (s - out[-1][0]) == p:  # the same source goes on
            a, w, d, p0 = out[-1]
            out[-1], last = (a, w + n, d, p0), s + n
            end = a + w + n
            continue
        skip = max(0, end - s)
        if skip < n:
            out.append((s + skip, n - skip + WINDOW - 1, d, p + skip))
            end, last = s + n + WINDOW - 1, s + n
    return out


def _cover(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Words covered by the windows that start in the runs: those of the factors and of the windows over their boundaries."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + lengths + WINDOW - 1, n), -1)
    return np.cumsum(step[:-1]) > 0


_RUN = "doc_id long, pos long, length int, from_doc long, from_pos long"


def duplicate_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, runs): texts is (doc_id, text, copy, nth, first), bucketed by doc_id; runs is (doc_id, runs) of duplicate windows."""
    spark = docs.sparkSession
    ship(spark)
    rows = _texts(docs)
    # Equal texts: all but one row with the smallest id are copies.
    words = F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")
    keyed = cut(rows.where("doc_id is not null").select("doc_id", F.md5(words).alias("key")), "keys")
    firsts = keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    total = keyed.count()
    copies = join_groups(keyed, firsts, ["key"], "n", total, F.xxhash64("doc_id")).where("doc_id > first").select("doc_id", "key", F.lit(True).alias("copy"), F.lit(0).alias("nth"), "first")
    # Ids of several rows: their different texts are numbered.
    shared = keyed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    several = join_groups(keyed, shared, ["doc_id"], "rows", total, F.xxhash64("key")).where("rows is not null").select("doc_id", "key").distinct()
    several = several.select("doc_id", "key", F.lit(False).alias("copy"), (F.row_number().over(Window.partitionBy("doc_id").orderBy("key")) - 1).alias("nth"), F.lit(None).cast("long").alias("first"))
    known = cut(copies.unionByName(several).groupBy("doc_id", "key").agg(F.max("copy").alias("copy"), F.max("nth").alias("nth"), F.max("first").alias("first")), "copies")
    known = known.withColumnsRenamed({"doc_id": "_tw_id", "key": "_tw_key"})
    later = F.col("doc_id").isNotNull() & (F.row_number().over(Window.partitionBy("doc_id", "key").orderBy("key")) > 1)

    def mark(t: DataFrame) -> DataFrame:
        """Of the rows that share doc_id and text, one stands for all.  startsWith, not equality: as a join key it would exchange the texts again."""
        t = t.withColumn("key", F.md5(words))
        t = t.join(known.hint("merge"), (F.col("doc_id") == F.col("_tw_id")) & F.col("key").startswith(F.col("_tw_key")), "left")
        return t.select("doc_id", "text", (F.coalesce("copy", F.lit(False)) | later).alias("copy"), F.coalesce("nth", F.lit(0)).cast("long").alias("nth"), F.coalesce("first", "doc_id").alias("first"))

    texts = bucketed(rows, "doc_id", "texts", mark)
    free_shuffles(spark)
    live = texts.where("doc_id is not null and not copy")
    found = live.mapInArrow(_seed_rows, "seed long, doc_id long, pos long, known boolean, repeated boolean")
    # Known rows are spread evenly; firsts meet by seed.
    route = F.when(F.col("known"), F.xxhash64("doc_id", "pos")).otherwise(F.xxhash64("seed"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = found.repartition(n, route)  # by the expression itself: a column for it would travel along
    met = met.select("known", "seed", "doc_id", "pos", "repeated").sortWithinPartitions("known", "seed", "doc_id", "pos")
    again = met.mapInArrow(_repeated_seeds, "doc_id long, pos long")
    at = cut(again.groupBy("doc_id").agg(F.collect_set("pos").alias("at")), "seeds")
    free_shuffles(spark)
    wide = live.join(at, "doc_id").select("doc_id", "text", "at", "nth").mapInArrow(_window_rows, f"w1 long, w2 long, {_RUN}")
    wide = cut(wide, "windows")
    by_key = wide.where("length = 0").select("w1", "w2", "doc_id", "pos").repartition(n, "w1").sortWithinPartitions("w1", "w2", "doc_id", "pos")
    runs = by_key.mapInArrow(_duplicate_windows, _RUN).unionByName(wide.where("length > 0").drop("w1", "w2"))
    runs = runs.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "length", "from_doc", "from_pos")).alias("runs"))
    return texts, cut(runs, "runs")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space), factors (start, words, from_doc, from_start), a row
    for every row of docs."""
    texts, runs = duplicate_spans(docs)
    free_shuffles(docs.sparkSession)
    schema = "doc_id long, n_words long, n_removed long, kept_text string, factors array<struct<start: long, words: long, from_doc: long, from_start: long>>"
    names = ["start", "words", "from_doc", "from_start"]

    def run(batches):
        for batch in batches:
            for b in slices(batch, 1):
                w = Words(b.column(1))
                removed, out, factors = [], [], []
                copy, nth, first = b.column(2).to_pylist(), b.column(4).to_numpy(), b.column(5).to_pylist()
                lists = b.column(3)
                flat = pc.struct_field(lists.values, "pos").to_numpy(), *(pc.struct_field(lists.values, c).to_numpy() for c in ("length", "from_doc", "from_pos"))
                offsets, some = lists.offsets.to_numpy(), lists.is_valid().to_pylist()
                raw = w.data.tobytes()
                for i in range(b.num_rows):
                    words, n, found = raw[w.at[i] : w.at[i + 1]].split(), int(w.counts[i]), []
                    if copy[i] and n >= WINDOW:
                        words, found = [], [(0, n, first[i], 0)]
                    elif some[i]:
                        pos, length, from_doc, from_pos = (x[offsets[i] : offsets[i + 1]] for x in flat)
                        own = pos >> SHIFT == nth[i]
                        if own.any():
                            pos, length = pos[own] & _WITHIN, length[own]
                            found = parse(pos, length, from_doc[own], from_pos[own] & _WITHIN)
                            gone = _cover(pos, length, n)
                            words = [x for x, g in zip(words, gone.tolist()) if not g]
                    removed.append(n - len(words))
                    out.append(b" ".join(words).decode())
                    factors.append([dict(zip(names, f)) for f in found])
                kind = pa.list_(pa.struct([(c, pa.int64()) for c in names]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string()), pa.array(factors, kind)], names=["doc_id", "n_words", "n_removed", "kept_text", "factors"])

    both = texts.join(runs, "doc_id", "left").select("doc_id", "text", "copy", "runs", "nth", "first")
    return both.mapInArrow(run, schema)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL: dict[str, str] = {}
