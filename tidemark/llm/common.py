"""What the corpus operators share: reading tables, shared checkpoints, word patterns, size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship

#: A word, as every operator here understands it: a run without the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A corpus table, with ``prepared`` workers."""
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(spark: SparkSession) -> None:
    """Python workers get this package, and Arrow batches of at most 8 MB unless the session sets its own size."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).removesuffix("b") == str(64 << 20):  # Spark's own default
        spark.conf.set(key, "8m")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words; null counts as an empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage into the folder that all executors share (``spark.checkpoint.dir``).

    The files outlive a lost executor. Only where the setting is absent, as in
    local tests, is a temporary folder used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint(eager=True)


def small_or_shuffled(df: DataFrame, rows: int, row_bytes: int, limit_bytes: int = 8 << 20) -> DataFrame:
    """Mark ``df`` for broadcasting if its measured size is under the limit; else leave it to a shuffled join.

    ``rows`` must have been counted on ``df`` itself. Without the mark, adaptive
    execution splits hot keys of the other side.
    """
    return F.broadcast(df) if rows * row_bytes <= limit_bytes else df


def shielded(df: DataFrame, names) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns that have one of ``names`` (in any case) renamed, and how to name them back."""
    taken = {n.lower() for n in names}
    away = {c: f"_kept{i}_" for i, c in enumerate(df.columns) if c.lower() in taken}
    return df.withColumnsRenamed(away), {b: a for a, b in away.items()}
