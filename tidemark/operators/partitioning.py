"""How rows lie over partitions: dealing them out, and seeing where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def round_robin(df: DataFrame, partitions: int) -> DataFrame:
    return df.repartition(partitions)


def by_key(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)


def by_range(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    return df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)


def gathered(df: DataFrame) -> DataFrame:
    """Everything in one partition, for small results."""
    return df.coalesce(1)


def partition_count(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


def partition_profile(df: DataFrame) -> DataFrame:
    """Rows per partition that has any."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n_rows"))


def skew_report(df: DataFrame, *keys: str, top: int = 10) -> DataFrame:
    """The most frequent keys with their share of all rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    total = df.count()
    return counts.withColumn("share", F.col("n_rows") / F.lit(max(1, total))).orderBy(F.col("n_rows").desc(), *keys).limit(top)
