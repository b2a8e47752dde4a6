"""Operator 1, quality rules: a rule bitmask ledger.

Every rule is evaluated once a document; the ledger holds one row a document with the measurements and one bit a failed
rule.  Policies are versioned masks over those bits, so judging by another policy, or asking what a rule adds, never reads
a text again: verdicts are one bitwise AND, and ablations aggregate the few distinct bit patterns.

Defined cases: null text has no words and fails the base rules.  Lines count as duplicates only if they hold a word.
Ratios of a text without words are 0.  Repeated rows give repeated ledger rows.  Rows are independent of each other, so a
hot source or a group of copies has no effect on partitioning, and a very long text is one slice of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from .batches import slices
from .common import table
from .words import Words, mix, windows

#: Rules in bit order; a bit, once given, keeps its meaning.  (name, failure as an expression over the measurements)
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > 4 * n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("short_mean_word", "n_words > 0 and word_chars < 2 * n_words"),
    ("long_mean_word", "word_chars > 20 * n_words"),
    ("upper_case", "10 * n_upper > 8 * word_chars"),
]
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules each enforces.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": BASE,
    "web-1": (*BASE, "many_symbols", "duplicate_lines", "short_mean_word", "long_mean_word"),
    "web-2": (*BASE, "many_symbols", "duplicate_lines", "short_mean_word", "long_mean_word", "upper_case"),
}
CURRENT = "web-2"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_LETTER = np.ones(256, dtype=np.int64)  # bytes that start a character and aren't white space
_LETTER[128:192] = 0
_LETTER[[0x20, *range(0x09, 0x0E)]] = 0


def measure(texts: pa.Array) -> list[np.ndarray]:
    """MEASURES of each text, as int64 arrays."""
    w = Words(texts)
    n = len(texts)
    total = lambda weights: np.add.reduceat(weights[w.data], w.at[:-1]) if n else np.zeros(0, np.int64)
    h = w.hashes()
    repeats = np.zeros(n, np.int64)
    if len(h) > 2:
        of = np.repeat(np.arange(n), w.counts)
        keys = windows(h, 3)
        inside = of[2:] == of[:-2]
        keys = mix(keys[inside] + mix(of[2:][inside].astype(np.uint64) + np.uint64(1)))
        at = np.flatnonzero(inside)
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(h), bool)
        for k in range(3):
            covered[at[twice] + k] = True
        repeats = np.bincount(of[covered], minlength=n)
    lines, dup = np.zeros(n, np.int64), np.zeros(n, np.int64)
    raw = w.data.tobytes()
    for i in range(n):
        own = [x for x in raw[w.at[i] : w.at[i + 1] - 1].split(b"\n") if x and not x.isspace()]
        lines[i], dup[i] = len(own), len(own) - len(set(own))
    return [w.counts.astype(np.int64), total(_LETTER), total(_SYMBOL), dup, repeats, lines, total(_UPPER)]


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements, failed long: bit i is set if rule i of RULES fails."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for b in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x) for x in measure(b.column(1))]], names=["doc_id", *MEASURES])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)), F.lit(0))
    return measured.withColumn("failed", bits.cast("long"))


def mask(rules: tuple[str, ...]) -> int:
    names = [n for n, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


def passes(policy: str, bits: str = "failed") -> Column:
    """Whether a ledger row passes a policy version."""
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(ledger_rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents and words failing it, failing it alone, and kept if it were dropped.

    The ledger is first aggregated to its distinct bit patterns (at most 2^rules rows, combined before the exchange).
    """
    every = mask(POLICIES[policy])
    own = ledger_rows.select(F.col("failed").bitwiseAND(F.lit(every)).alias("bits"), "n_words").groupBy("bits").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_words").alias("words"))
    names = [n for n, _ in RULES]
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]]))
    long = own.select("*", rules.alias("r")).select("bits", "docs", "words", "r.rule", "r.bit")
    hit, alone, rest = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit"), F.col("bits").bitwiseAND(F.lit(every) - F.col("bit")) == 0
    some = lambda c, v: F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0))
    return long.groupBy("rule").agg(some(hit, "docs").alias("failing"), some(alone, "docs").alias("failing_alone"), some(rest, "docs").alias("kept_without"), some(rest, "words").alias("words_kept_without"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents, judged by the base rules and the current policy."""
    rows = ledger(table(spark, sf_dir, "documents"))
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0
    return rows.select("doc_id", *MEASURES[:5], base.alias("base_failed"), passes(CURRENT).alias("kept"), "n_lines", "n_upper", F.col("failed").alias("failed_bits"))


SQL = {
    "op1_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rn, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
k AS (SELECT rn, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g AS (SELECT rn, i, count(*) OVER (PARTITION BY rn, w[i], w[i + 1], w[i + 2]) AS c FROM k),
c AS (SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest([i, i + 1, i + 2]) AS p FROM g WHERE c > 1) GROUP BY rn),
l AS (SELECT rn, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT rn, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY rn),
m AS (SELECT w.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
  length(regexp_replace(w.t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(l.dup, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  coalesce(l.n, 0)::BIGINT AS n_lines, length(regexp_replace(w.t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper FROM w LEFT JOIN l USING (rn) LEFT JOIN c USING (rn)),
b AS (SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > 4 * n_words)::BIGINT + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT
  + 16 * (n_words > 0 AND word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT + 64 * (10 * n_upper > 8 * word_chars)::BIGINT)::BIGINT AS failed_bits FROM m)
SELECT *, failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept FROM b""",
}
