"""Aggregations by key. All but ``grouped_sum`` combine on the map side before the exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import count_equal, longest_length, space_split


def family(df: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """sum, min, max, mean, count and sample standard deviation in one pass."""
    made = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "count": F.count, "stddev": F.stddev_samp}
    return df.groupBy(*keys).agg(*[f(value).alias(f"{n}_{value}") for n, f in made.items()])


def reduced(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias("total"))


def folded(df: DataFrame, key: str, value: str, zero=0) -> DataFrame:
    """As a fold with a neutral ``zero``: a key without values gets it."""
    return df.groupBy(key).agg(F.coalesce(F.sum(value), F.lit(zero)).alias("total"))


def aggregated(df: DataFrame, key: str, value: str) -> DataFrame:
    """A (sum, count) state per key, and the mean from it."""
    return df.groupBy(key).agg(F.sum(value).alias("total"), F.count(value).alias("n")).withColumn("mean", F.col("total") / F.col("n"))


def combined(df: DataFrame, key: str, value: str, partitions: int = 2) -> DataFrame:
    """As ``reduced`` with a given number of result partitions."""
    return df.groupBy(key).agg(F.sum(value).alias("total")).repartition(partitions, key)


def grouped_sum(df: DataFrame, key: str, value: str) -> DataFrame:
    """The anti-pattern: all values of a key cross the exchange and are summed there. For comparison only."""
    zero = F.lit(0).cast(df.schema[value].dataType)
    return df.groupBy(key).agg(F.collect_list(value).alias("v")).select(key, F.aggregate("v", zero, lambda a, x: a + x).alias("total"))


def argmax(df: DataFrame, key: str, value: str, what: str) -> DataFrame:
    """The ``what`` of each key's largest value; of equal values the largest ``what``."""
    return df.groupBy(key).agg(F.max_by(what, F.struct(value, what)).alias(what), F.max(value).alias(value))


def int_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    """Both means: truncated to a whole number, and exact."""
    return df.groupBy(key).agg(F.expr(f"sum(`{value}`) div count(`{value}`)").alias("int_mean"), F.avg(value).alias("mean"))


def joined_names(df: DataFrame, value: str, sep: str = ", ", most: int = 1_000_000) -> DataFrame:
    """All values in one string, in order. The string is one row: more than ``most`` values raise an error."""
    few = F.count(value) <= most
    names = df.limit(most + 1).agg(F.collect_list(value).alias("v"), few.alias("few"))
    return names.select(F.when(F.col("few"), F.array_join(F.array_sort("v"), sep)).otherwise(F.raise_error(F.lit(f"more than {most} values"))).alias("names"))


def text_stats(df: DataFrame, key: str, text: str, target: str) -> DataFrame:
    """Per key in one pass: lines, words, longest word, and how often ``target`` stands as a word of its own."""
    words = space_split(F.col(text))
    return df.groupBy(key).agg(
        F.count("*").alias("n_lines"),
        F.sum(F.size(words).cast("long")).alias("n_words"),
        F.max(longest_length(words)).cast("long").alias("longest"),
        F.sum(count_equal(words, target).cast("long")).alias("n_target"),
    )


def word_counts(df: DataFrame, text: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """How often each space-separated word occurs; empty words don't count."""
    return df.select(*by, F.explode(space_split(text)).alias("word")).where("word <> ''").groupBy(*by, "word").agg(F.count("*").alias("n"))


def secondary_sort(df: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of a key in one partition, in value order, without gathering a key in memory."""
    return df.repartition(key).sortWithinPartitions(key, value)
