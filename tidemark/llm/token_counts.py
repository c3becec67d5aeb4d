"""Exact length histogram of a corpus in tokens.

Documents are encoded once and counted by encoded length. Suffix sums over the
histogram then answer, for every context limit, how many documents reach it,
their tokens, quantiles, and the total after truncation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed
from tidemark.llm.encoding import default_paths, encoder

#: Lengths are summed in blocks of so many: a running sum inside each block, and one over the blocks.
BLOCK = 128


def encoded_lengths(docs: DataFrame, paths=None) -> DataFrame:
    """``docs`` (text) to n_tokens (long), one row per row of ``docs``.

    A null or empty text has 0 tokens; texts of any length are encoded whole;
    repeated rows count each time; an empty table gives an empty result; other
    columns, whatever their names, are not read.
    """
    paths = tuple(paths or default_paths())

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(paths)
        for batch in batches:
            counts = [len(encode(x.as_py())) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(counts, pa.int64())], ["n_tokens"])

    return docs.select("text").mapInArrow(lengths, "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs. Counted per task before the exchange, so a frequent length costs one row per task."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(counts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per present length: n_docs, docs_at_least, tokens_at_least, truncated_tokens, docs_share.

    ``truncated_tokens`` is the total if every document is cut at that length;
    ``docs_share`` is the share of documents no longer than it. Sums run within
    blocks of lengths in parallel; the one window over everything sees a row
    per block. An empty table gives an empty result.
    """
    counts = checkpointed(counts)  # one row per length; read twice, and not worth encoding twice
    counts = counts.withColumn("block", F.floor(F.col("n_tokens") / block))
    tokens = F.col("n_tokens") * F.col("n_docs")
    totals = counts.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "block",
        F.coalesce(F.sum("docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("docs").over(whole).alias("all_docs"),
        F.sum("tokens").over(whole).alias("all_tokens"),
    )
    inner = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    docs_from = F.sum("n_docs").over(inner) + F.col("docs_above")
    tokens_from = F.sum(tokens).over(inner) + F.col("tokens_above")
    return counts.join(totals, "block").select(
        "n_tokens",
        "n_docs",
        docs_from.alias("docs_at_least"),
        tokens_from.alias("tokens_at_least"),
        (F.col("all_tokens") - tokens_from + F.col("n_tokens") * docs_from).alias("truncated_tokens"),
        ((F.col("all_docs") - docs_from + F.col("n_docs")) / F.col("all_docs")).alias("docs_share"),
        "all_docs",
        "all_tokens",
    )


def at_limits(sums: DataFrame, limits) -> DataFrame:
    """For each limit: documents at or over it, their tokens, and the total tokens kept when cut at it.

    The suffix sums of a limit are those of the shortest length that reaches it.
    """
    wanted = F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("limit")
    reached = F.when(F.col("n_tokens") >= F.col("limit"), F.struct("n_tokens", "docs_at_least", "tokens_at_least"))
    return (
        sums.select("n_tokens", "docs_at_least", "tokens_at_least", "all_tokens", wanted)
        .groupBy("limit")
        .agg(F.min(reached).alias("r"), F.max("all_tokens").alias("all_tokens"))
        .select(
            "limit",
            F.coalesce("r.docs_at_least", F.lit(0)).alias("docs_at_least"),
            F.coalesce("r.tokens_at_least", F.lit(0)).alias("tokens_at_least"),
            (
                F.col("all_tokens") - F.coalesce("r.tokens_at_least", F.lit(0)) + F.col("limit") * F.coalesce("r.docs_at_least", F.lit(0))
            ).alias("truncated_tokens"),
        )
    )


def quantiles(sums: DataFrame, shares) -> DataFrame:
    """For each share: the least length such that at least that share of the documents is no longer."""
    wanted = F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share")
    return (
        sums.select("n_tokens", "docs_share", wanted)
        .where("docs_share >= share")
        .groupBy("share")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )
