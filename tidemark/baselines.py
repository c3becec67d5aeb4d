"""Straightforward and RDD twins of the operators. Only tests and benchmarks use them."""

from __future__ import annotations

from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs(df: DataFrame, key: str, value: str) -> RDD:
    return df.select(key, value).rdd.map(lambda r: (r[0], r[1]))


def group_by_key_sum(rdd: RDD) -> RDD:
    return rdd.groupByKey().mapValues(sum)


def reduce_by_key_sum(rdd: RDD) -> RDD:
    return rdd.reduceByKey(lambda a, b: a + b)


def fold_by_key_sum(rdd: RDD) -> RDD:
    return rdd.foldByKey(0, lambda a, b: a + b)


def aggregate_by_key_mean(rdd: RDD) -> RDD:
    state = rdd.aggregateByKey((0, 0), lambda s, x: (s[0] + x, s[1] + 1), lambda a, b: (a[0] + b[0], a[1] + b[1]))
    return state.mapValues(lambda s: s[0] / s[1])


def combine_by_key_sum(rdd: RDD, partitions: int = 2) -> RDD:
    return rdd.combineByKey(lambda x: x, lambda a, x: a + x, lambda a, b: a + b, numPartitions=partitions)


def sort_take(rdd: RDD, k: int) -> list:
    return rdd.sortBy(lambda r: -r[1]).take(k)


def heap_take(rdd: RDD, k: int) -> list:
    return rdd.takeOrdered(k, key=lambda r: (-r[1], r[0]))


def chained_join(a: RDD, b: RDD, c: RDD) -> RDD:
    return a.join(b).join(c)


def cogrouped(a: RDD, b: RDD, c: RDD) -> RDD:
    return a.groupWith(b, c)


def co_partitioned_join(a: RDD, b: RDD, partitions: int = 10) -> RDD:
    """The second side takes the first one's partitioner, so the join moves nothing more."""
    a = a.partitionBy(partitions)
    return b.partitionBy(a.getNumPartitions()).reduceByKey(max).join(a)


def map_side_join(big: RDD, small: DataFrame, key: str, value: str) -> RDD:
    """A bounded side as a broadcast variable, looked up within each partition."""
    table = big.context.broadcast({r[0]: r[1] for r in small.select(key, value).limit(100_000).collect()})
    return big.mapPartitions(lambda rows: ((k, (v, table.value[k])) for k, v in rows if k in table.value))


def typed_map_times_five(df: DataFrame) -> DataFrame:
    """A row-wise Python map where a column expression would do."""
    return df.mapInPandas(lambda batches: (b * 5 for b in batches), df.schema)


def exam_pass_count(scores: RDD, names: RDD, above: float, aggregate_first: bool) -> int:
    if aggregate_first:
        return scores.reduceByKey(max).filter(lambda r: r[1] > above).join(names).count()
    best = scores.join(names).mapValues(lambda v: (v[0], v[1])).reduceByKey(lambda a, b: a if a[0] > b[0] else b)
    return best.filter(lambda r: r[1][0] > above).count()


def widen_then_join(a: DataFrame, b: DataFrame, columns: int, key: str = "id") -> DataFrame:
    """The anti-pattern of pre-partitioning: round-robin, then columns, then the join shuffles the wide rows."""
    wide = a.select(key, *[(F.col(key) * i).alias(f"newCol{i}") for i in range(1, columns + 1)])
    return wide.join(b, key)
