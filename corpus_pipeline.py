"""The corpus pipeline: toxicity, near-duplicates, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; its result is written as Parquet to the shared checkpoint
folder and read again as the next stage's documents. All stages but the last
return the columns of documents; other columns of the input are left out. An
empty table gives an empty result everywhere, and texts of any length are read
whole.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, secrets, simhash_wide, toxicity
from tidemark.llm.common import DOCUMENT_COLUMNS, prepared, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier chain rejects; it learns from the labelled ones among ``docs``.

    A null or empty text is not toxic; a probability at the threshold is;
    repeated rows are judged alike and stay as often as they occur; without
    labels on both sides nothing goes.
    """
    prepared(spark)
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.cleaned(docs.select(*DOCUMENT_COLUMNS), chain)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by a similarity of 0.8 or more over five-word shingles, that with the smallest id.

    Null ids come last; texts without words (null, empty) are one group; of
    repeated rows one stays.
    """
    prepared(spark)
    return simhash_wide.deduplicated(docs.select(*DOCUMENT_COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret in the texts; all documents stay, repeated ones too. ``n_chars`` follows the new text; a null text stays null with its ``n_chars``."""
    clean = secrets.redacted(docs.select(*DOCUMENT_COLUMNS))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emit each document as often as its source's target asks for.

    A null source is one of its own; texts without words have size 0 and share
    their source's rate; rows equal in id, source and size are drawn alike.
    """
    return mixing.mixed(docs.select(*DOCUMENT_COLUMNS))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into windows; the rows are pieces of documents.

    A null text counts as empty; repeated rows and equal or null ids are packed once each.
    """
    prepared(spark)
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_copies),
    ("secrets", without_secrets),
    ("mixing", mixed_to_targets),
    ("packing", packed_sequences),
]

#: The first and last stages (trained models, tokenizers) have no SQL form; tests compare the pipeline with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the last stage's rows."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidemark-")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:  # what came before has been read for the last time
            old = spark._jvm.org.apache.hadoop.fs.Path(before)
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        docs, before = spark.read.parquet(path), path
    return docs
