"""Operator 2, line dedup: distinct-site spread of lines.

Every line gets a hash; HyperLogLog sketches of the sites it occurs on merge by aggregation, one sketch a line hash.
Lines whose estimate lies in the band around the threshold get an exact distinct count.  A line on at least SPREAD sites is
boilerplate: it stays where it occurs first (smallest doc_id, then smallest line number) and goes everywhere else, so a text
that is copied across sites keeps one whole copy.

Lines are compared trimmed; those of fewer than MIN_WORDS words are left alone.  A text is its \\n-separated lines; the lines
that stay are joined by \\n again, a text that loses none is returned as it was.

Sketches combine before the exchange; lines meet the boilerplate table by a join that no line can skew; texts move once.

Defined cases: null text stays null and has no lines.  A null site is a site of its own.  Rows with a null doc_id lose no
line and make no first occurrence, but their sites count.  Rows that share a doc_id lose the same lines.  Very long texts are
split like others, one at a time.  An empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .batches import slices
from .common import cut, free_shuffles, join_groups, table

SPREAD = 8
MIN_WORDS = 5
#: log2 of the sketch's registers: its standard error is 1.04 / sqrt(2^LG).
LG = 11
#: Standard errors around the threshold within which lines are counted exactly.
BAND = 6


def line_rows(docs: DataFrame, site: str = "source", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, pos, key, site: a row for every line of at least min_words words."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.xxhash64(F.concat(F.lit("s"), F.col(site).cast("string"))), F.lit(0)).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.regexp_replace("line", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""))
    lines = lines.where(F.col("line").rlike(rf"^[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){{{min_words - 1}}}"))
    return lines.select("doc_id", "pos", F.unhex(F.md5("line")).alias("key"), "site")


def boilerplate(lines: DataFrame, total: int, spread: int = SPREAD) -> DataFrame:
    """key, occurrences, first (struct of doc_id, pos) of lines on at least `spread` sites; total is the number of lines."""
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "pos")))
    seen = lines.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG))).alias("estimate"), F.count(F.lit(1)).alias("occurrences"), first.alias("first"))
    margin = max(1.0, BAND * 1.04 / 2 ** (LG / 2) * spread)
    seen = cut(seen.where(F.col("estimate") >= spread - margin), "spread")
    near = seen.where(F.col("estimate") <= spread + margin)
    # However often a line occurs, its rows are spread before they are looked up, and then it has one row a site.
    some = join_groups(lines, near.select("key", "occurrences"), ["key"], "occurrences", total, F.xxhash64("doc_id", "pos"))
    pairs = some.where("occurrences is not null").groupBy("key", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= spread)
    sure = seen.where(F.col("estimate") > spread + margin)
    return cut(sure.unionByName(near.join(exact.select("key"), "key", "left_semi")).select("key", "occurrences", "first"), "boilerplate")


def removals(docs: DataFrame, site: str = "source", spread: int = SPREAD, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, gone: the numbers of the lines that go, for documents that lose any."""
    lines = cut(line_rows(docs, site, min_words), "lines")
    free_shuffles(docs.sparkSession)
    total = lines.count()
    known = boilerplate(lines, total, spread)
    hits = join_groups(lines.select("doc_id", "pos", "key"), known, ["key"], "occurrences", total, F.xxhash64("doc_id", "pos"))
    hits = hits.where("doc_id is not null and occurrences is not null and (doc_id <> first.doc_id or pos <> first.pos)")
    return hits.groupBy("doc_id").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, site: str = "source", spread: int = SPREAD, min_words: int = MIN_WORDS, counts: bool = True) -> DataFrame:
    """All rows and columns of docs, text without its boilerplate lines, then, with `counts`, n_lines and n_removed (long), to
    which columns of docs with these names give way."""
    ship(docs.sparkSession)
    gone = cut(removals(docs, site, spread, min_words), "gone").withColumnRenamed("doc_id", "_tw_id").withColumnRenamed("gone", "_tw_gone")
    free_shuffles(docs.sparkSession)
    keep = [c for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    # By exchange at every size: what goes grows with the corpus.
    both = docs.join(gone.hint("merge"), F.col("doc_id") == F.col("_tw_id"), "left").select(*[docs[c] for c in keep], "_tw_gone")
    where = keep.index("text")

    def run(batches):
        for batch in batches:
            for b in slices(batch, where):
                texts, n, removed = [], [], []
                for t, g in zip(b.column(where).to_pylist(), b.column(len(keep)).to_pylist()):
                    lines = [] if t is None else t.split("\n")
                    n.append(len(lines))
                    removed.append(len(g) if g and t is not None else 0)
                    if removed[-1]:
                        out = set(g)
                        t = "\n".join(x for i, x in enumerate(lines) if i not in out)
                    texts.append(t)
                columns = list(b.columns[: len(keep)])
                columns[where] = pa.array(texts, pa.string())
                more = [pa.array(n, pa.int64()), pa.array(removed, pa.int64())] if counts else []
                yield pa.RecordBatch.from_arrays([*columns, *more], names=names)

    names = [*keep, "n_lines", "n_removed"] if counts else keep
    schema = both.select(*keep).schema
    return both.mapInArrow(run, schema.add("n_lines", "long").add("n_removed", "long") if counts else schema)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = {
    "op2_line_dedup": rf"""
WITH d AS (SELECT doc_id, source, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS ls FROM documents),
e AS (SELECT doc_id, source, unnest(range(len(ls))) AS pos, ls FROM d),
l AS (SELECT doc_id, source, pos, regexp_replace(ls[pos + 1], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS x FROM e),
m AS (SELECT * FROM l WHERE len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= {MIN_WORDS}),
b AS (SELECT x, min(doc_id * 10000000 + pos) AS first FROM m GROUP BY x HAVING count(DISTINCT coalesce('s' || source, '')) >= {SPREAD}),
g AS (SELECT doc_id, list(pos) AS gone FROM m JOIN b USING (x) WHERE doc_id * 10000000 + pos <> first GROUP BY doc_id)
SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN coalesce(text, '') ELSE array_to_string(list_filter(ls, lambda y, i: NOT list_contains(gone, i - 1)), chr(10)) END) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)""",
}
