"""From raw documents to token ids, in five stages; each is written as Parquet and reread as the next one's docs.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.  A column
of docs beyond those of the documents table passes through, whatever its name.

Repeated rows: quality_classifier and line_dedup treat rows that share an id alike; near_dedup keeps one row of an id;
source_mixing takes each row as often as the mix takes that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm import bpe, classifier, lines, mixing, neardup
from tidewell.llm.common import delete, free_shuffles, scratch_path, stage


def _id() -> Column:
    return F.col("doc_id").cast("long")


def _whole(**columns: Column) -> dict[str, Column]:
    """Columns as keys that join plainly: each as a value that is never null, and whether it was."""
    out = {}
    for name, c in columns.items():
        out |= {f"_tw_{name}": F.coalesce(c.cast("string"), F.lit("")), f"_tw_{name}_null": c.isNull()}
    return out


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of quality; rows that share an id are judged together, by their best score."""
    with stage(docs) as done:
        judged = classifier.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        good = judged.groupBy(F.col("doc_id").alias("_tw_id")).agg(F.max("predicted").alias("_tw_good")).where("_tw_good = 1")
        return done(docs.join(good.hint("merge"), _id().eqNullSafe(F.col("_tw_id")), "left_semi"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are boilerplate across sources; n_chars follows the text."""
    with stage(docs) as done:
        out = lines.dedup_lines(docs, counts=False)
        if "n_chars" in docs.columns:
            out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        return done(out)


#: What the stage calls near-duplicates: documents whose sets of five-word shingles have a similarity of 0.8 or more.
NEAR_WORDS, NEAR = 5, (80, 100)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id; of rows that share that id, the one whose
    text has the least digest.  Rows without an id stay if their group has no id, one a text."""
    with stage(docs) as done:
        kept = neardup.near_duplicates(docs, NEAR, NEAR_WORDS).where("kept").select(*[c.alias(k + "2") for k, c in _whole(id=F.col("doc_id")).items()]).distinct()
        own = docs.withColumns(_whole(id=_id()))
        key = ["_tw_id", "_tw_id_null"]
        both = own.join(kept.hint("merge"), [F.col(k) == F.col(k + "2") for k in key])
        text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))
        # One window on the join's own partitioning, so texts move once.
        both = both.withColumn("_tw_text", text).withColumn("_tw_nth", F.row_number().over(Window.partitionBy(*key, F.when(F.col("_tw_id_null"), F.col("_tw_text"))).orderBy("_tw_text")))
        return done(both.where("_tw_nth = 1").select(*docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it; one of no copies goes.  Rows equal in id, source and text share their copies evenly."""
    with stage(docs) as done:
        own = docs.withColumns(_whole(id=_id(), source=F.col("source"), text=mixing.text_hash()))
        copies = mixing.mix(docs).select(*[c.alias(k + "2") for k, c in _whole(id=F.col("doc_id"), source=F.col("source"), text=F.col("text_hash")).items()], "copies")
        key = [c for c in own.columns if c not in docs.columns]
        copies = copies.groupBy(*[k + "2" for k in key]).agg(F.sum("copies").alias("_tw_copies"), F.count(F.lit(1)).alias("_tw_rows")).where("_tw_copies > 0")
        both = own.join(copies.hint("merge"), [F.col(k) == F.col(k + "2") for k in key])
        nth = F.row_number().over(Window.partitionBy(*key).orderBy("_tw_text"))
        share = F.floor(F.col("_tw_copies") / F.col("_tw_rows")) + (nth <= F.col("_tw_copies") % F.col("_tw_rows")).cast("long")
        taken = both.withColumn("_tw_n", share).where("_tw_n > 0")
        return done(taken.withColumn("_tw_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_tw_n")))).select(*docs.columns))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents without text, then input_ids, n_tokens; columns of docs with these two names give way."""
    with stage(docs) as done:
        return done(bpe.encode(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("bpe_encoding", bpe_encoding),
]

#: Classifier, cube sampling and byte-pair merges have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each stage's result is a table in the shared folder, which goes once the next is written."""
    docs, previous = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        step(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
        if previous:
            delete(spark, previous)
        previous = path
        free_shuffles(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
