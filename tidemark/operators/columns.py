"""Projections and row-wise maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_columns(df: DataFrame, count: int, key: str = "id") -> DataFrame:
    """``key`` and count multiples of it, as one projection (a chain of withColumn would grow the plan)."""
    return df.select(key, *[(F.col(key) * i).alias(f"newCol{i}") for i in range(1, count + 1)])


def pruned(df: DataFrame, *needed: str, **derived: Column) -> DataFrame:
    """Only the needed columns, with row-wise expressions evaluated before a join multiplies the rows."""
    return df.select(*needed, *[c.alias(name) for name, c in derived.items()])


def qualified(joined: DataFrame, **picks: Column) -> DataFrame:
    """Columns picked through their parents (``left["name"]``), under new names."""
    return joined.select(*[c.alias(name) for name, c in picks.items()])


def exploded(df: DataFrame, array: str, name: str) -> DataFrame:
    """One row per array element; rows with a null or empty array go."""
    return df.withColumn(name, F.explode(array))


def labelled(df: DataFrame, name: str, test: Column, yes: str, no: str) -> DataFrame:
    return df.withColumn(name, F.when(test, yes).otherwise(no))
