import pytest
from pyspark.sql import functions as F

from tests.conftest import same
from tidemark import baselines
from tidemark.functions import capitalized, full_name, passed, space_split
from tidemark.operators import bykey, partitioning, sinks, topk
from tidemark.plans import inspect_plan
from tidemark.sources import generators


def frame(spark):
    return spark.createDataFrame([("a", 1), ("a", 5), ("b", 2), ("b", None), (None, 7), ("a", 5), ("c", None)], "k string, v long")


def test_sums_agree(spark):
    df = frame(spark)
    want = bykey.reduced(df, "k", "v")
    assert same(want, bykey.combined(df, "k", "v")) and same(want, bykey.aggregated(df, "k", "v").select("k", "total"))
    assert same(want.where("k <> 'c'"), bykey.grouped_sum(df, "k", "v").where("k <> 'c'"))
    assert bykey.folded(df, "k", "v").where("k = 'c'").first().total == 0
    pairs = generators.word_pairs(spark, 2000)
    rdd = baselines.pairs(pairs, "word", "n")
    made = {r.word: r.total for r in bykey.reduced(pairs, "word", "n").collect()}
    for twin in (baselines.group_by_key_sum, baselines.reduce_by_key_sum, baselines.fold_by_key_sum, baselines.combine_by_key_sum):
        assert dict(twin(rdd).collect()) == made
    means = {r.word: r.mean for r in bykey.aggregated(pairs, "word", "n").collect()}
    assert dict(baselines.aggregate_by_key_mean(rdd).collect()) == pytest.approx(means)


def test_only_the_anti_pattern_moves_all_rows(spark):
    pairs = generators.word_pairs(spark, 100)
    assert inspect_plan(bykey.reduced(pairs, "word", "n")).partial_aggregate
    assert "collect_list" in inspect_plan(bykey.grouped_sum(pairs, "word", "n")).text


def test_argmax_breaks_ties(spark):
    df = spark.createDataFrame([("a", 5, "x"), ("a", 5, "y"), ("a", 1, "z"), ("b", None, "w")], "k string, v int, w string")
    assert {tuple(r) for r in bykey.argmax(df, "k", "v", "w").collect()} == {("a", "y", 5), ("b", "w", None)}


def test_int_mean(spark):
    df = spark.createDataFrame([(103, 10), (103, 5), (105, -1), (105, 0)], "dept int, salary int")
    assert {tuple(r) for r in bykey.int_mean(df, "dept", "salary").collect()} == {(103, 7, 7.5), (105, 0, -0.5)}


def test_text_stats(spark):
    rows = [(1, "one two  two "), (1, ""), (1, "Two two, two."), (2, "abc"), (2, None)]
    got = {r.s: tuple(r)[1:] for r in bykey.text_stats(spark.createDataFrame(rows, "s int, t string"), "s", "t", "two").collect()}
    assert got[1] == (3, 8, 4, 2) and got[2][0] == 2 and got[2][2] == 3


def test_family_and_names(spark):
    got = bykey.family(frame(spark), "v").first()
    assert (got.sum_v, got.min_v, got.max_v, got.count_v) == (20, 1, 7, 5)
    assert bykey.joined_names(frame(spark), "k").first().names == "a, a, a, b, b, c"


def test_top_k(spark):
    df = spark.createDataFrame([("p", 9.0), ("q", 9.0), ("r", 1.0), ("s", 8.0)], "name string, value double")
    got = topk.top_k(df, 2, F.col("value").desc(), "name")
    assert [tuple(r) for r in got.collect()] == [("p", 9.0), ("q", 9.0)] and inspect_plan(got).bounded_sort
    assert [tuple(r) for r in topk.top_k(df, 2, F.col("value").desc(), distinct="value").collect()] == [("p", 9.0), ("s", 8.0)]
    assert topk.top_k(df.limit(0), 2, "value").count() == 0
    data = generators.metrics(spark, 3000)
    want = [r.value for r in topk.top_k(data, 10, "value").collect()]
    assert [r.value for r in topk.top_k_per_partition(data, 10, "value").collect()] == want
    rdd = baselines.pairs(data, "name", "value")
    assert baselines.sort_take(rdd, 10) == baselines.heap_take(rdd, 10)


def test_order_and_partitions(spark):
    df = spark.createDataFrame([(None,), (1,), (3,)], "v int")
    assert [r.v for r in topk.sorted_desc(df, "v").collect()] == [3, 1, None]
    assert partitioning.partition_count(partitioning.round_robin(df, 3)) == 3
    assert partitioning.partition_count(partitioning.gathered(spark.range(100))) == 1
    assert partitioning.partition_profile(partitioning.by_key(spark.range(1000), "id", partitions=4)).agg(F.sum("n_rows")).first()[0] == 1000
    assert partitioning.by_range(spark.range(50), "id", partitions=2).rdd.getNumPartitions() == 2
    report = partitioning.skew_report(generators.encounters(spark, 20, 4000, 0.6), "personId", top=1).first()
    assert report.personId == "person_0" and 0.57 < report.share < 0.67
    parts = bykey.secondary_sort(generators.encounters(spark, 5, 200), "personId", "approachValue").rdd.glom().collect()
    assert all(p == sorted(p) for p in parts)


def test_scalars(spark):
    df = spark.createDataFrame([("a b  ", 9.0), (" x", None), ("éa b", 3.0)], "t string, m double")
    got = df.select(space_split(F.col("t")).alias("w"), capitalized(F.col("t")).alias("c"), passed(F.col("m")).alias("p"), passed(F.col("m"), inclusive=False).alias("q")).collect()
    assert [tuple(r) for r in got] == [(["a", "b"], "A b  ", "PASSED", "FAILED"), (["", "x"], " x", None, None), (["éa", "b"], "Éa b", "FAILED", "FAILED")]
    assert df.select(full_name(F.lit("A"), F.lit(None), F.lit("B")).alias("n")).first().n == "A B"
    assert df.limit(1).select(space_split(F.lit("1 // x // y"), " // ").alias("w")).first().w == ["1", "x", "y"]


def test_maps_have_a_bound(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert sinks.as_map(df, "k", "v") == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        sinks.as_map(df, "k", "v", most=1)
    assert same(baselines.typed_map_times_five(spark.range(9)), spark.range(9).selectExpr("id * 5 AS id"))
