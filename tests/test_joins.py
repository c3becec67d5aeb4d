import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import same
from tests.fixtures import bands, guitars, players
from tidemark import baselines
from tidemark.operators import columns, joins
from tidemark.plans import classify_join, inspect_plan
from tidemark.session import no_broadcast
from tidemark.sources import generators, lookup_table


@pytest.mark.parametrize("how,n", [("inner", 3), ("left_outer", 5), ("right_outer", 5), ("outer", 7), ("left_semi", 3), ("left_anti", 2)])
def test_kinds(spark, how, n):
    p, b = players(spark), bands(spark)
    assert joins.equi(p, b, p["band"] == b["id"], how).count() == n


def test_cross_with_and_without_nulls(spark):
    p, b = players(spark), bands(spark)
    assert joins.cross(p, b).count() == 20 and joins.cross(p, b, "band").count() == 16


def test_using_keeps_the_key_once(spark):
    a, b = spark.range(5), spark.range(3, 9)
    assert joins.equi(a, b, "id").columns == ["id"]
    assert joins.equi(bands(spark), bands(spark), ["id", "name"]).columns == ["id", "name", "hometown", "year", "hometown", "year"]


def test_contains_forms_agree(spark):
    p, g = players(spark).withColumnRenamed("id", "pid"), guitars(spark)
    naive, fast = (joins.contains_join(p, g, "guitars", "id", e).select("pid", "model") for e in (False, True))
    assert same(naive, fast) and fast.count() == 5
    assert not {"BroadcastNestedLoopJoin", "CartesianProduct"} & set(inspect_plan(fast).joins)
    assert {"BroadcastNestedLoopJoin", "CartesianProduct"} & set(inspect_plan(naive).joins)


def test_qualified_and_pruned(spark):
    p, b = players(spark), bands(spark)
    got = columns.qualified(joins.equi(p, b, p["band"] == b["id"]), player=p["name"], band=b["name"])
    assert {tuple(r) for r in got.collect()} == {("Ada", "Quiet Harbor"), ("Bo", "Paper Lanterns"), ("Cy", "Quiet Harbor")}
    assert columns.pruned(guitars(spark), "id", make=F.upper("make")).first().make == "FENN"


def test_broadcast_only_what_was_counted(spark):
    big, small = spark.range(10_000), lookup_table(spark)
    assert inspect_plan(joins.broadcast_join(big, small, "id")).joins == ["BroadcastHashJoin"]
    with no_broadcast(spark):
        assert inspect_plan(joins.broadcast_join(big, small, "id", max_bytes=3)).joins == ["SortMergeJoin"]
    assert inspect_plan(joins.merge_join(big, small, "id")).joins == ["SortMergeJoin"]


def test_exchange_counts_of_pre_partitioning(spark):
    with no_broadcast(spark):
        a, b = spark.range(1000).repartition(7), spark.range(500).repartition(5)
        late = baselines.widen_then_join(a, b, 5)
        early = joins.co_partitioned(spark.range(1000), spark.range(500), "id", 6)
        early = early.select("id", *[(F.col("id") * i).alias(f"newCol{i}") for i in range(1, 6)])
        wide = columns.add_columns(spark.range(1000), 5).repartition("id").join(b, "id")
        assert [inspect_plan(x).exchanges for x in (late, early, wide)] == [4, 2, 3]
        assert same(late, early) and same(late, wide)
        assert classify_join(inspect_plan(early)) == "co-partitioned" and classify_join(inspect_plan(late)) == "shuffled"


speeds = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-40, 40).map(lambda x: x / 10))), max_size=25)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(speeds, speeds, st.sampled_from([0.1, 0.35, 1.0, 7.0]))
def test_band_join_equals_naive(spark, left, right, width):
    a, b = (spark.createDataFrame([(*r, i) for i, r in enumerate(x)], "k string, v double, i int") for x in (left, right))
    assert same(joins.band_join(a, b, ["k"], "v", width), joins.band_join(a, b, ["k"], "v", width, naive=True))


def test_ticks_find_all_neighbours(spark):
    grid = spark.createDataFrame([("m", x / 10) for x in range(30, 39)], "k string, v double")
    assert joins.tick_join(grid, grid, ["k"], "v", 10).count() == 25
    assert grid.join(grid.toDF("k", "w"), "k").where("abs(v - w) <= 0.1").count() == 13  # binary fractions lose most
    with pytest.raises(ValueError):
        joins.band_join(grid, grid, ["k"], "v", 0)


@pytest.mark.parametrize("skew", [0, 0.5, 0.95])
def test_skewed_laptops(spark, skew):
    a, b = generators.laptops(spark, 400, skew), generators.laptop_offers(spark, 600, skew)
    ticks = joins.tick_join(a, b, ["make", "model"], "procSpeed", 10)
    naive = joins.band_join(a, b, ["make", "model"], "procSpeed", 0.1 + 1e-9, naive=True)
    assert same(ticks, naive) and ticks.count() > 0
    mean = F.round(F.avg("salePrice_r"), 6).alias("m")
    paired = ticks.groupBy("registration", "make", "model", "procSpeed").agg(mean, F.count("*").alias("n_near"), F.sum("salePrice_r").alias("s"))
    summed = joins.tick_aggregate(a.distinct(), b, ["make", "model"], "procSpeed", 10, "salePrice")
    assert same(paired, summed.select("registration", "make", "model", "procSpeed", F.round("mean_salePrice", 6).alias("m"), "n_near", F.col("sum_salePrice").alias("s")))


def test_cogroup_modes_and_exchanges(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, name string")
    b = spark.createDataFrame([(1, 5.0), (1, 9.5), (3, 1.0)], "k int, score double")
    c = spark.createDataFrame([(1, "p"), (4, "q")], "k int, mail string")
    made = {"name": F.max("name"), "best": F.max("score"), "mail": F.max("mail")}
    outer = joins.multi_cogroup({"a": a, "b": b, "c": c}, "k", made)
    inner = joins.multi_cogroup({"a": a, "b": b, "c": c}, "k", made, "inner")
    assert {r.k for r in outer.collect()} == {1, 2, 3, 4} and [tuple(r) for r in inner.collect()] == [(1, "x", 9.5, "p")]
    assert inspect_plan(inner).exchanges == 1
    pairs = [baselines.pairs(f.where("k is not null"), "k", v) for f, v in ((a, "name"), (b, "score"), (c, "mail"))]
    assert set(baselines.cogrouped(*pairs).keys().collect()) == {1, 2, 3, 4}
    assert baselines.chained_join(*pairs).count() == 2


@pytest.mark.parametrize("inclusive,n", [(False, 1), (True, 2)])
def test_filter_and_aggregate_before_the_join(spark, inclusive, n):
    facts = spark.createDataFrame([(1, 9.0), (1, 3.0), (2, 9.5), (3, None), (5, 9.9)], "id int, score double")
    dims = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, name string")
    got = joins.pre_aggregated_max(facts, dims, "id", "score", 9.0, inclusive)
    assert got.count() == n
    plan = inspect_plan(joins.pre_aggregated_max(facts, dims, "id", "score", 9.0)).text
    assert plan.index("Join") < plan.index("partial_max") < plan.index("> 9.0")


def test_rdd_twins_of_exam_counts(spark):
    ids, _, scores = generators.exam_data(spark, 300)
    names, marks = baselines.pairs(ids, "id", "name"), baselines.pairs(scores, "id", "score")
    want = joins.pre_aggregated_max(scores, ids, "id", "score", 9.0).count()
    assert baselines.exam_pass_count(marks, names, 9.0, True) == baselines.exam_pass_count(marks, names, 9.0, False) == want
    joined = baselines.co_partitioned_join(names, marks)
    assert joined.count() == 300


def test_map_side_join(spark):
    board, awards = generators.leaderboard(spark, 500), spark.createDataFrame([(0, "gold"), (1, "silver"), (2, "bronze")], "position int, award string")
    got = baselines.map_side_join(baselines.pairs(board, "position", "name"), awards, "position", "award")
    want = joins.broadcast_join(board, awards, "position").select("position", "name", "award")
    assert {(k, *v) for k, v in got.collect()} == {tuple(r) for r in want.collect()}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salting_changes_nothing(spark, how):
    hot = spark.range(2000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    dim = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert same(joins.salted(hot, dim, "k", 5, how), hot.join(dim, "k", how))
    with pytest.raises(ValueError):
        joins.salted(hot, dim, "k", 5, "outer")
    assert joins.salts_for(12_000_000) == 3
