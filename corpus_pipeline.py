"""Corpus pipeline: the documents pass five operators of ``knowspark.llm`` in turn.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All stages but the
last return the columns of ``documents``; the last returns ids and digests of
the encoded documents.  Rows with a null id take part as the operators define
it: they are judged, cut and encoded, but neither deduplicated nor counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knowspark.llm import bpe, decontam, lines, minhash, toxicity
from knowspark.llm.common import WS, fresh, saved, table

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    columns = docs.columns
    wrapped = docs.select(F.struct(*columns).alias("row"), F.col("text").alias("text"))
    return toxicity.toxicity(wrapped, model).filter("predicted = 0").select("row.*").select(*columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; ``n_chars`` follows the text where it is a column.

    A document that had words and lost all of them says nothing that others do
    not say, and goes; one that was blank from the start stays.
    """
    a, b = fresh(docs.columns, "n_lines"), fresh(docs.columns, "n_dropped")
    out = lines.line_dedup(docs, n_lines=a, n_dropped=b)
    out = out.filter((F.col(b) == 0) | F.col("text").rlike(f"[^{WS}]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(b) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    gone = saved(minhash.near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("gone")).distinct(), "pipeline-gone")
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("gone"), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    return bpe.encode(docs, full=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("minhash", drop_near_copies),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
