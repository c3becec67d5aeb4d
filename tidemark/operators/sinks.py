"""Writing: JSON, bucketed and partitioned tables, views, and looking at a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_bucketed(df: DataFrame, name: str, buckets: int, *keys: str, partition_by: tuple[str, ...] = (), sort: bool = True) -> DataFrame:
    """A catalog table in hash buckets (within partition directories if asked for), which joins and groups on the
    keys read without an exchange. Rows are dealt to their buckets first, so that a bucket is one file per directory."""
    writer = df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys)
    if sort:
        writer = writer.sortBy(*keys)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def as_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def as_map(df: DataFrame, key: str, value: str, most: int = 100_000) -> dict:
    """A small result as a dictionary; of equal keys the last row wins. More than ``most`` rows raise an error."""
    rows = df.select(key, value).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    return {r[0]: r[1] for r in rows}


def inspect(df: DataFrame, rows: int = 20) -> int:
    """Print schema, first rows and size; the size is returned."""
    df.printSchema()
    df.show(rows)
    size = df.count()
    print(f"Size: {size}")
    return size
