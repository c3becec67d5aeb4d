"""Bounded sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, k: int, *by, distinct: str | None = None) -> DataFrame:
    """The first k rows by the given order: a heap of k per task, then one merge; nothing is sorted as a whole.

    ``distinct`` names a column of which each value counts once (the row kept is the first by the order).
    """
    if distinct is not None:
        rest = [c for c in df.columns if c != distinct]
        df = df.groupBy(distinct).agg(F.min(F.struct(*rest)).alias("_r")).select(distinct, "_r.*").select(*df.columns)
    return df.orderBy(*by).limit(k)


def top_k_per_partition(df: DataFrame, k: int, by: str) -> DataFrame:
    """The same by hand with pandas: k rows of every batch, then k of the whole. For comparison only."""

    def first(batches):
        for pdf in batches:
            yield pdf.nsmallest(k, by)

    return df.mapInPandas(first, df.schema).coalesce(1).orderBy(by).limit(k)


def sorted_desc(df: DataFrame, column: str) -> DataFrame:
    """A global order, largest first, nulls last."""
    return df.orderBy(F.col(column).desc_nulls_last())
