"""The library's own queries over the driver tables, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import capitalized, passed
from tidemark.operators import bykey, columns, joins, partitioning, sinks, topk
from tidemark.sources import driver_table, range_source, read_json, read_lines
from tidemark.sources import generators
from tidemark.session import ship
from tidemark.streaming import event_stream, run_to_files, run_to_memory, sessions, windowed

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    def put(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return put


def alias(name: str, of: str, function) -> None:
    """Another formulation of the same query: the same SQL must hold."""
    QUERIES[name] = function
    SQL[name] = SQL[of]


def _t(spark: SparkSession, sf_dir: str, *names: str):
    found = [driver_table(spark, sf_dir, n) for n in names]
    return found[0] if len(found) == 1 else found


# Flagship: filter, three-key average, nulls last.


@query(
    "avg_by_three_keys",
    """SELECT l_returnflag, l_linestatus, l_linenumber, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n
       FROM lineitem WHERE l_quantity > 10 AND l_discount >= 0.02 GROUP BY 1, 2, 3""",
)
def avg_by_three_keys(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem").filter("l_quantity > 10 AND l_discount >= 0.02")
    grouped = items.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(
        F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count("*").alias("n")
    )
    return topk.sorted_desc(grouped, "avg_price")


# Projections and filters.


@query("select_arith", "SELECT c_custkey, c_acctbal / 2.2 AS bal_kg, round(c_acctbal / 2.2, 2) AS bal_2, c_acctbal + 1 AS next_bal, c_acctbal - 1 AS last_bal FROM customer")
def select_arith(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(
        F.col("c_custkey"),
        (F.col("c_acctbal") / 2.2).alias("bal_kg"),
        F.expr("round(c_acctbal / 2.2, 2) AS bal_2"),
        (F.col("c_acctbal") + 1).alias("next_bal"),
        (F.col("C_ACCTBAL") - 1).alias("last_bal"),
    )


@query("select_multiples", "SELECT o_orderkey, o_orderkey * 1 AS newCol1, o_orderkey * 2 AS newCol2, o_orderkey * 3 AS newCol3 FROM orders")
def select_multiples(spark, sf_dir):
    return columns.add_columns(_t(spark, sf_dir, "orders"), 3, "o_orderkey")


@query("filter_neq", "SELECT o_orderkey, o_orderstatus FROM orders WHERE nullif(o_orderstatus, 'P') <> 'F'")
def filter_neq(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").withColumn("s", F.expr("nullif(o_orderstatus, 'P')"))
    return orders.filter(F.col("s") != "F").select("o_orderkey", "o_orderstatus")


@query("filter_and", "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size > 10 AND p_retailprice <= 1500")
def filter_and(spark, sf_dir):
    return _t(spark, sf_dir, "part").filter("p_size > 10 AND p_retailprice <= 1500").select("p_partkey", "p_brand", "p_size")


@query("sql_where", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def sql_where(spark, sf_dir):
    return spark.sql("SELECT c_custkey, c_name FROM {customer} WHERE c_mktsegment = 'BUILDING'", customer=_t(spark, sf_dir, "customer"))


@query("sql_view", "SELECT n_name FROM nation WHERE n_regionkey = 1")
def sql_view(spark, sf_dir):
    sinks.as_view(_t(spark, sf_dir, "nation"), "tidemark_nation")
    return spark.sql("SELECT n_name FROM tidemark_nation WHERE n_regionkey = 1")


@query("where_on_dropped_column", "SELECT p_name, p_retailprice AS price FROM part WHERE p_size = 15 AND p_retailprice > 950")
def where_on_dropped_column(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_name", F.col("p_retailprice").alias("price"))
    return part.where((F.col("p_size") == 15) & (F.col("p_retailprice") > 950)).orderBy(F.col("price").desc_nulls_last())


@query("capitalized_names", "SELECT n_nationkey, upper(lower(n_name)[1:1]) || lower(n_name)[2:] AS cap, upper(n_name) AS up, lower(n_name) AS low FROM nation")
def capitalized_names(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation")
    return nation.select("n_nationkey", capitalized(F.lower("n_name")).alias("cap"), F.upper("n_name").alias("up"), F.lower("n_name").alias("low"))


# Aggregations.


@query("agg_global", "SELECT round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem")
def agg_global(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").agg(F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


@query(
    "agg_family",
    """SELECT l_returnflag, round(sum(l_quantity), 2) AS sum_l_quantity, min(l_quantity) AS min_l_quantity, max(l_quantity) AS max_l_quantity,
       round(avg(l_quantity), 6) AS mean_l_quantity, count(l_quantity) AS count_l_quantity, round(stddev_samp(l_quantity), 6) AS stddev_l_quantity
       FROM lineitem GROUP BY 1""",
)
def agg_family(spark, sf_dir):
    got = bykey.family(_t(spark, sf_dir, "lineitem"), "l_quantity", ("l_returnflag",))
    return got.withColumns({f"{n}_l_quantity": F.round(f"{n}_l_quantity", d) for n, d in (("sum", 2), ("mean", 6), ("stddev", 6))})


@query("count_by", "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1")
def count_by(spark, sf_dir):
    return _t(spark, sf_dir, "orders").groupBy("o_orderpriority").count()


@query("argmax_by_key", "SELECT l_orderkey, arg_max(l_partkey, {'a': l_extendedprice, 'b': l_partkey}) AS l_partkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1")
def argmax_by_key(spark, sf_dir):
    return bykey.argmax(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_extendedprice", "l_partkey")


_SUM = "SELECT event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1"


def _cents(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("v"))


@query("sum_by_key_reduce", _SUM)
def sum_by_key_reduce(spark, sf_dir):
    return bykey.reduced(_cents(spark, sf_dir), "event_type", "v")


alias("sum_by_key_group", "sum_by_key_reduce", lambda spark, d: bykey.grouped_sum(_cents(spark, d), "event_type", "v"))
alias("sum_by_key_fold", "sum_by_key_reduce", lambda spark, d: bykey.folded(_cents(spark, d), "event_type", "v"))
alias("sum_by_key_aggregate", "sum_by_key_reduce", lambda spark, d: bykey.aggregated(_cents(spark, d), "event_type", "v").select("event_type", "total"))
alias("sum_by_key_combine", "sum_by_key_reduce", lambda spark, d: bykey.combined(_cents(spark, d), "event_type", "v"))


@query("mean_by_key", "SELECT user_id, round(sum(value) / count(value), 6) AS mean FROM events GROUP BY 1")
def mean_by_key(spark, sf_dir):
    return bykey.aggregated(_t(spark, sf_dir, "events"), "user_id", "value").select("user_id", F.round("mean", 6).alias("mean"))


@query("int_mean_by_key", "SELECT p_brand, CAST(sum(p_size) // count(p_size) AS BIGINT) AS int_mean, round(avg(p_size), 6) AS mean FROM part GROUP BY 1")
def int_mean_by_key(spark, sf_dir):
    return bykey.int_mean(_t(spark, sf_dir, "part"), "p_brand", "p_size").withColumn("mean", F.round("mean", 6))


@query("name_concat", "SELECT string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation")
def name_concat(spark, sf_dir):
    return bykey.joined_names(_t(spark, sf_dir, "nation"), "n_name")


@query(
    "text_stats",
    """WITH w AS (SELECT source, string_split(rtrim(text, ' '), ' ') AS ws FROM documents WHERE text IS NOT NULL)
       SELECT source, count(*) AS n_lines, CAST(sum(len(ws)) AS BIGINT) AS n_words, CAST(max(list_max(list_transform(ws, lambda x: length(x)))) AS BIGINT) AS longest,
       CAST(sum(len(list_filter(ws, lambda x: x = 'the'))) AS BIGINT) AS n_target FROM w GROUP BY 1""",
)
def text_stats(spark, sf_dir):
    return bykey.text_stats(_t(spark, sf_dir, "documents").where("text is not null"), "source", "text", "the")


@query(
    "word_count",
    """SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(string_split(lower(text), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1, 2""",
)
def word_count(spark, sf_dir):
    return bykey.word_counts(_t(spark, sf_dir, "documents"), F.lower("text"), ("lang",))


@query("word_color_join", "SELECT * FROM (VALUES ('blue', 1::BIGINT, 1::BIGINT), ('orange', 1, 3), ('red', 1, 4), ('yellow', 1, 2)) AS t(word, n, score)")
def word_color_join(spark, sf_dir):
    text = spark.createDataFrame([("the Sky was blue and RED over orange and yellow fields",)], "line string")
    colors = spark.createDataFrame([("blue", 1), ("yellow", 2), ("orange", 1), ("orange", 2), ("red", 4), ("green", 5)], "word string, s long")
    scores = colors.groupBy("word").agg(F.sum("s").alias("score"))
    return bykey.word_counts(text, F.lower("line")).join(scores, "word")


# Joins.

# Whole customers against dear orders; those still in progress have a null key, so that both sides have rows without a partner.
_SMALL = "(SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS o_key FROM orders WHERE o_totalprice > 150000)"
_PICK = "c.c_custkey AS c_custkey, c.c_name AS c_name, o.o_orderkey AS o_orderkey, o.o_totalprice AS o_totalprice"
_ON = f"customer c {{}} JOIN {_SMALL} o ON c.c_custkey = o.o_key"


def _kind(how: str):
    def run(spark, sf_dir):
        customer, orders = _t(spark, sf_dir, "customer", "orders")
        orders = orders.where("o_totalprice > 150000").withColumn("o_key", F.expr("CASE WHEN o_orderstatus <> 'P' THEN o_custkey END"))
        got = joins.equi(customer, orders, customer["c_custkey"] == orders["o_key"], how)
        if how in ("left_semi", "left_anti"):
            return got.select("c_custkey", "c_name")
        return columns.qualified(
            got, c_custkey=customer["c_custkey"], c_name=customer["c_name"], o_orderkey=orders["o_orderkey"], o_totalprice=orders["o_totalprice"]
        )

    return run


for _how, _sql in (("inner", "INNER"), ("left_outer", "LEFT"), ("right_outer", "RIGHT"), ("outer", "FULL")):
    QUERIES[f"join_{_how}"] = _kind(_how)
    SQL[f"join_{_how}"] = f"SELECT {_PICK} FROM {_ON.format(_sql)}"
for _how, _sql in (("left_semi", "SEMI"), ("left_anti", "ANTI")):
    QUERIES[f"join_{_how}"] = _kind(_how)
    SQL[f"join_{_how}"] = f"SELECT c.c_custkey AS c_custkey, c.c_name AS c_name FROM {_ON.format(_sql)}"


@query("join_anti_orders", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti_orders(spark, sf_dir):
    orders, items = _t(spark, sf_dir, "orders", "lineitem")
    return joins.equi(orders, items, orders["o_orderkey"] == items["l_orderkey"], "left_anti").select("o_orderkey")


@query("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, sf_dir):
    region, nation = _t(spark, sf_dir, "region", "nation")
    return joins.cross(region, nation).select("r_name", "n_name")


@query("join_cross_nulldrop", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE nullif(r_name, 'ASIA') IS NOT NULL")
def join_cross_nulldrop(spark, sf_dir):
    region, nation = _t(spark, sf_dir, "region", "nation")
    return joins.cross(region.withColumn("k", F.expr("nullif(r_name, 'ASIA')")), nation, "k").select("r_name", "n_name")


@query("join_using_one", "SELECT k, o_custkey, l_partkey FROM (SELECT o_orderkey AS k, o_custkey FROM orders) JOIN (SELECT l_orderkey AS k, l_partkey FROM lineitem) USING (k)")
def join_using_one(spark, sf_dir):
    orders, items = _t(spark, sf_dir, "orders", "lineitem")
    return joins.equi(orders.select(F.col("o_orderkey").alias("k"), "o_custkey"), items.select(F.col("l_orderkey").alias("k"), "l_partkey"), "k")


@query(
    "join_using_multi",
    """SELECT a.p_brand, a.p_size, n, total FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2) a
       JOIN (SELECT p_brand, p_size, round(sum(p_retailprice), 2) AS total FROM part WHERE p_size > 5 GROUP BY 1, 2) b USING (p_brand, p_size)""",
)
def join_using_multi(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    a = part.groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    b = part.where("p_size > 5").groupBy("p_brand", "p_size").agg(F.round(F.sum("p_retailprice"), 2).alias("total"))
    return joins.equi(a, b, ["p_brand", "p_size"])


_CONTAINS = """SELECT l.l_orderkey AS l_orderkey, p.p_partkey AS p_partkey, upper(p_brand) AS brand
  FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l JOIN part p ON l.l_partkey = p.p_partkey"""


def _contains(spark, sf_dir):
    items, part = _t(spark, sf_dir, "lineitem", "part")
    held = items.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    part = columns.pruned(part, "p_partkey", brand=F.upper("p_brand"))
    return joins.contains_join(held, part, "parts", "p_partkey").select("l_orderkey", "p_partkey", "brand")


# The nested loop (``exploded=False``) tests every part with every order; over whole tables both names take the equality join.
QUERIES["join_contains"], SQL["join_contains"] = _contains, _CONTAINS
alias("join_contains_exploded", "join_contains", _contains)

_NATION = "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey"


def _nation(how: str):
    def run(spark, sf_dir):
        customer, nation = _t(spark, sf_dir, "customer", "nation")
        on = customer["c_nationkey"] == nation["n_nationkey"]
        made = {
            "broadcast": lambda: joins.broadcast_join(customer, nation, on),
            "auto": lambda: customer.join(nation, on),
            "auto_swapped": lambda: nation.join(customer, on),
            "merge": lambda: joins.merge_join(customer, nation, on),
        }
        return made[how]().select("c_custkey", "n_name")

    return run


for _name, _how in (("join_broadcast", "broadcast"), ("join_auto_broadcast", "auto"), ("join_auto_swapped", "auto_swapped"), ("join_sort_merge", "merge")):
    QUERIES[_name], SQL[_name] = _nation(_how), _NATION

_WIDE = """SELECT o_orderkey AS id, o_orderkey * 1 AS newCol1, o_orderkey * 2 AS newCol2, o_orderkey * 3 AS newCol3, n
  FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey"""


def _prepartitioned(scenario: int):
    def run(spark, sf_dir):
        orders, items = _t(spark, sf_dir, "orders", "lineitem")
        a = orders.select(F.col("o_orderkey").alias("id"))
        b = items.groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
        if scenario == 1:  # widen, then let the join shuffle the wide rows
            return columns.add_columns(partitioning.round_robin(a, 7), 3).join(b, "id")
        if scenario == 2:  # deal out by the key first, join, widen last
            got = joins.co_partitioned(a, b, "id")
            return got.select("id", *[(F.col("id") * i).alias(f"newCol{i}") for i in range(1, 4)], "n")
        return partitioning.by_key(columns.add_columns(a, 3), "id").join(b, "id")  # deal out after widening

    return run


for _i in (1, 2, 3):
    QUERIES[f"join_prepartitioned_s{_i}"], SQL[f"join_prepartitioned_s{_i}"] = _prepartitioned(_i), _WIDE

_made: dict[tuple[str, ...], str] = {}


def _bucketed(spark, df: DataFrame, what: str, sf_dir: str, *keys: str, partition_by=()) -> DataFrame:
    """A bucketed copy, made once per application."""
    mark = (spark.sparkContext.applicationId, sf_dir, what)
    if mark not in _made:
        name = f"tidemark_{what}_{uuid.uuid4().hex[:12]}"
        sinks.save_bucketed(df, name, 4, *keys, partition_by=partition_by)
        _made[mark] = name
    return spark.table(_made[mark])


@query("join_bucketed", "SELECT k, o_custkey, l_quantity FROM (SELECT o_orderkey AS k, o_custkey FROM orders) JOIN (SELECT l_orderkey AS k, l_quantity FROM lineitem) USING (k)")
def join_bucketed(spark, sf_dir):
    orders, items = _t(spark, sf_dir, "orders", "lineitem")
    a = _bucketed(spark, orders.select(F.col("o_orderkey").alias("k"), "o_custkey"), "orders", sf_dir, "k")
    b = _bucketed(spark, items.select(F.col("l_orderkey").alias("k"), "l_quantity"), "items", sf_dir, "k")
    return a.join(b, "k")


@query("bucket_prune", "SELECT l_orderkey AS k, l_quantity FROM lineitem WHERE l_orderkey = 10")
def bucket_prune(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem")
    return _bucketed(spark, items.select(F.col("l_orderkey").alias("k"), "l_quantity"), "items", sf_dir, "k").where("k = 10")


@query("agg_bucketed", "SELECT l_returnflag, l_suppkey, round(avg(l_extendedprice), 4) AS avg_price FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2")
def agg_bucketed(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem").select("l_returnflag", "l_suppkey", "l_extendedprice")
    made = _bucketed(spark, items, "flagged", sf_dir, "l_suppkey", partition_by=("l_returnflag",))
    return made.where("l_returnflag = 'R'").groupBy("l_returnflag", "l_suppkey").agg(F.round(F.avg("l_extendedprice"), 4).alias("avg_price"))


# Band joins.

_BAND = """SELECT a.p_partkey AS p_partkey, round(avg(b.p_retailprice), 4) AS avg_price, count(*) AS n FROM part a
  JOIN part b ON a.p_brand = b.p_brand AND abs(a.p_size - b.p_size) <= {} GROUP BY 1"""


def _band(form: str, width: float = 1):
    """Pairs are formed between distinct sizes of a brand, by ``form``; a brand's parts of one size are summed before."""

    def near(a, b):
        if form == "ticks":
            return joins.tick_join(a, b, ["p_brand"], "p_size", 1)
        return joins.band_join(a, b, ["p_brand"], "p_size", width, naive=form == "naive")

    def run(spark, sf_dir):
        part = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
        got = joins.band_aggregate(part, part, ["p_brand"], "p_size", "p_retailprice", near)
        return got.select("p_partkey", F.round("mean_p_retailprice", 4).alias("avg_price"), F.col("n_near").alias("n"))

    return run


@query("band_join_aggregated", _BAND.format(1))
def band_join_aggregated(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    got = joins.tick_aggregate(part, part, ["p_brand"], "p_size", 1, "p_retailprice")
    return got.select("p_partkey", F.round("mean_p_retailprice", 4).alias("avg_price"), F.col("n_near").alias("n"))


for _form in ("naive", "bucketed", "ticks"):
    QUERIES[f"band_join_{_form}"], SQL[f"band_join_{_form}"] = _band(_form), _BAND.format(1)
QUERIES["band_join_wide"], SQL["band_join_wide"] = _band("bucketed", 2.5), _BAND.format(2.5)


@query(
    "band_join_double",
    """WITH l AS (SELECT l_suppkey, l_discount, count(*) AS n FROM lineitem GROUP BY 1, 2)
       SELECT a.l_suppkey AS l_suppkey, a.l_discount AS l_discount, CAST(sum(b.n) AS BIGINT) AS near FROM l a
       JOIN l b ON a.l_suppkey = b.l_suppkey AND abs(CAST(round(a.l_discount * 100) AS BIGINT) - CAST(round(b.l_discount * 100) AS BIGINT)) <= 1 GROUP BY 1, 2""",
)
def band_join_double(spark, sf_dir):
    counts = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_discount").agg(F.count("*").alias("n"))
    return joins.tick_join(counts, counts, ["l_suppkey"], "l_discount", 100).groupBy("l_suppkey", "l_discount").agg(F.sum("n_r").alias("near"))


@query(
    "join_salted",
    """SELECT k, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_suppkey END AS k, l_quantity FROM lineitem)
       JOIN (SELECT s_suppkey AS k FROM supplier UNION SELECT 0) USING (k) GROUP BY 1""",
)
def join_salted(spark, sf_dir):
    items, supplier = _t(spark, sf_dir, "lineitem", "supplier")
    hot = items.select("*", F.expr("CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_suppkey END").alias("k"))
    keys = supplier.select(F.col("s_suppkey").alias("k")).union(spark.range(1).select("id")).distinct()
    return joins.salted(hot, keys, "k", 8).groupBy("k").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("skew_report", "SELECT k, count(*) AS n_rows, count(*) / (SELECT count(*) FROM lineitem) AS share FROM (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_suppkey END AS k FROM lineitem) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def skew_report(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem").select(F.expr("CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_suppkey END").alias("k"))
    return partitioning.skew_report(items, "k")


# Best row per key joined to its owner: five formulations of one question.

_EXAM = "SELECT o_orderkey, o_custkey, best FROM orders JOIN (SELECT l_orderkey, max(l_extendedprice) AS best FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE best > 60000"


def _exam(form: str):
    def run(spark, sf_dir):
        orders, items = _t(spark, sf_dir, "orders", "lineitem")
        orders = orders.select("o_orderkey", "o_custkey")
        items = items.select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
        if form == "join_first":
            got = orders.join(items, "o_orderkey").groupBy("o_orderkey", "o_custkey").agg(F.max("l_extendedprice").alias("best")).where("best > 60000")
        elif form == "agg_first":
            got = orders.join(items.groupBy("o_orderkey").agg(F.max("l_extendedprice").alias("best")), "o_orderkey").where("best > 60000")
        elif form == "filter_first":
            got = joins.pre_aggregated_max(items, orders, "o_orderkey", "l_extendedprice", 60000)
        elif form == "copartitioned":
            got = joins.co_partitioned(orders, items, "o_orderkey").groupBy("o_orderkey", "o_custkey").agg(F.max("l_extendedprice").alias("best")).where("best > 60000")
        else:
            best = items.where("l_extendedprice > 60000").repartition("o_orderkey").groupBy("o_orderkey").agg(F.max("l_extendedprice").alias("best"))
            got = orders.repartition("o_orderkey").join(best, "o_orderkey")
        return got.select("o_orderkey", "o_custkey", "best")

    return run


for _form in ("join_first", "agg_first", "filter_first", "copartitioned", "combined"):
    QUERIES[f"exam_{_form}"], SQL[f"exam_{_form}"] = _exam(_form), _EXAM

_NOTIFY = """SELECT k, c_name, best, n_events, CASE WHEN best IS NULL THEN NULL WHEN best >= 200000 THEN 'PASSED' ELSE 'FAILED' END AS label FROM
  (SELECT c_custkey AS k, c_name FROM customer) {0} JOIN (SELECT o_custkey AS k, max(o_totalprice) AS best FROM orders GROUP BY 1) USING (k)
  {0} JOIN (SELECT user_id AS k, count(*) AS n_events FROM events GROUP BY 1) USING (k)"""


def _notify(how: str, chained: bool = False):
    def run(spark, sf_dir):
        customer, orders, events = _t(spark, sf_dir, "customer", "orders", "events")
        a = customer.select(F.col("c_custkey").alias("k"), "c_name")
        b = orders.select(F.col("o_custkey").alias("k"), "o_totalprice")
        c = events.select(F.col("user_id").alias("k"), F.lit(1).alias("one"))
        if chained:
            best, n = b.groupBy("k").agg(F.max("o_totalprice").alias("best")), c.groupBy("k").agg(F.count("*").alias("n_events"))
            got = a.join(best, "k").join(n, "k")
        else:
            made = {"c_name": F.first("c_name", ignorenulls=True), "best": F.max("o_totalprice"), "n_events": F.expr("nullif(count(one), 0)")}
            got = joins.multi_cogroup({"a": a, "b": b, "c": c}, "k", made, how)
        return got.select("k", "c_name", "best", "n_events", passed(F.col("best"), 200000).alias("label"))

    return run


QUERIES["notify_inner"], SQL["notify_inner"] = _notify("inner"), _NOTIFY.format("INNER")
QUERIES["notify_chained"], SQL["notify_chained"] = _notify("inner", True), _NOTIFY.format("INNER")
QUERIES["notify_outer"], SQL["notify_outer"] = _notify("outer"), _NOTIFY.format("FULL")


# Top-k and order.


@query("top_k", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10")
def top_k(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return topk.top_k(items, 10, F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey")


@query("top_k_distinct", "SELECT l_extendedprice, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1 ORDER BY 1 DESC LIMIT 10")
def top_k_distinct(spark, sf_dir):
    items = _t(spark, sf_dir, "lineitem").select("l_extendedprice", "l_partkey")
    return topk.top_k(items, 10, F.col("l_extendedprice").desc(), distinct="l_extendedprice")


@query("sort_desc_nulls_last", "SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p FROM orders")
def sort_desc_nulls_last(spark, sf_dir):
    return topk.sorted_desc(_t(spark, sf_dir, "orders").select("o_orderkey", F.expr("nullif(o_orderpriority, '5-LOW') AS p")), "p")


@query("secondary_sort", "SELECT user_id, round(value, 4) AS value FROM events")
def secondary_sort(spark, sf_dir):
    return bykey.secondary_sort(_t(spark, sf_dir, "events").select("user_id", F.round("value", 4).alias("value")), "user_id", "value")


# Ranges, sources and sinks, generators.


def _range_sum(spark) -> DataFrame:
    """The sum of the odd multiples of 5 below 2e7, as a join of two ranges."""
    a = range_source(spark, 1, 10_000_000).selectExpr("id * 5 AS id")
    b = range_source(spark, 1, 20_000_000, 2)
    return a.join(b, "id").agg(F.sum("id").alias("total"))


SQL["range_sum"] = "SELECT CAST(sum(x) AS BIGINT) AS total FROM range(5, 20000000, 10) AS t(x)"
QUERIES["range_sum"] = lambda spark, sf_dir: _range_sum(spark)


@query("range_step_count", "SELECT count(*) AS n, CAST(sum(x) AS BIGINT) AS total FROM range(3, 100000, 7) AS t(x)")
def range_step_count(spark, sf_dir):
    return range_source(spark, 3, 100_000, 7).agg(F.count("*").alias("n"), F.sum("id").alias("total"))


@query("json_roundtrip", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def json_roundtrip(spark, sf_dir):
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidemark-")
    path = f"{shared}/json-{uuid.uuid4().hex}"
    sinks.write_json(part, path)
    return read_json(spark, path, part.schema)


@query("text_roundtrip", "SELECT n_name AS value FROM nation")
def text_roundtrip(spark, sf_dir):
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidemark-")
    path = f"{shared}/text-{uuid.uuid4().hex}"
    _t(spark, sf_dir, "nation").select("n_name").write.text(path)
    return read_lines(spark, path)


@query("partition_profile", "SELECT count(*) AS n_rows FROM orders")
def partition_profile(spark, sf_dir):
    profile = partitioning.partition_profile(partitioning.by_key(_t(spark, sf_dir, "orders"), "o_custkey", partitions=8))
    return profile.agg(F.sum("n_rows").alias("n_rows"))


@query("laptop_offers", None)
def laptop_offers(spark, sf_dir):
    """Average price of offers within a tenth of a GHz, per laptop, over seeded skewed data."""
    a, b = generators.laptops(spark, 40_000), generators.laptop_offers(spark, 100_000)
    got = joins.tick_aggregate(a, b, ["make", "model"], "procSpeed", 10, "salePrice")
    return got.groupBy("registration").agg(F.round(F.sum("sum_salePrice") / F.sum("n_near"), 4).alias("avg_price"))


# Streams over the events.


def _stream(kind: str):
    def run(spark, sf_dir):
        ship(spark)
        folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tidemark-")
        path = f"{folder}/events-{uuid.uuid4().hex}"
        _t(spark, sf_dir, "events").write.parquet(path)
        events = event_stream(spark, path)
        made = {"tumbling": lambda: windowed(events, "1 day"), "sliding": lambda: windowed(events, "2 days", "1 day"), "session": lambda: sessions(events, "6 hours")}[kind]()
        # there are as many sessions as events allow, but only a few windows a day
        got = run_to_files(made, folder) if kind == "session" else run_to_memory(made, f"tidemark_{kind}_{uuid.uuid4().hex[:8]}")
        rest = [F.round("total", 4).alias("total")] if "total" in got.columns else []
        key = "event_type" if "event_type" in got.columns else "user_id"
        return got.select(F.unix_timestamp("w_start").alias("w_start"), key, "n", *rest)

    return run


for _form in ("tumbling", "sliding", "session"):
    QUERIES[f"stream_{_form}"] = _stream(_form)
SQL["stream_tumbling"] = """SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS w_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"""
SQL["stream_sliding"] = """SELECT CAST(epoch(date_trunc('day', ts)) AS BIGINT) - 86400 * k AS w_start, event_type, count(*) AS n, round(sum(value), 4) AS total
  FROM events, (VALUES (0), (1)) AS v(k) GROUP BY 1, 2"""
SQL["stream_session"] = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
  SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS w_start, user_id, count(*) AS n FROM s GROUP BY user_id, s"""
