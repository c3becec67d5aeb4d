import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tidemark import queries
from tidemark.plans import inspect_plan
from tidemark.sources import generators

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, oracle, name):
    want = oracle.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())


def test_every_query_has_sql_or_is_generated():
    assert set(queries.QUERIES) - set(queries.SQL) == {"laptop_offers"}


def test_laptop_offers_at_the_size_of_the_reference(spark):
    got = {r.registration: r.avg_price for r in queries.QUERIES["laptop_offers"](spark, SMALL).collect()}
    offers = {}
    for r in generators.laptop_offers(spark, 100_000).collect():
        offers.setdefault((r.make, r.model), []).append((round(r.procSpeed * 10), r.salePrice))
    laptops = {}
    for r in generators.laptops(spark, 40_000).collect():
        laptops.setdefault(r.registration, []).append(((r.make, r.model), round(r.procSpeed * 10)))
    assert set(got) <= set(laptops) and len(got) > 2000
    for name in sorted(laptops)[::400]:
        near = [p for model, tick in laptops[name] for t, p in offers.get(model, []) if abs(t - tick) <= 1]
        assert got.get(name) == (pytest.approx(sum(near) / len(near), abs=1e-3) if near else None)


def test_entry_and_registers(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())


def test_flagship_plan(spark):
    report = inspect_plan(entry.entry(spark))
    assert report.partial_aggregate and report.exchanges == 2 and "l_orderkey" not in report.read_schemas[0]
    assert "GreaterThan(l_quantity,10.0)" in report.pushed_filters[0]


def test_library_works_without_the_corpus_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not any(q.startswith('op') or q == 'pipeline' for q in e.queries()); print(len(e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


@pytest.mark.parametrize("name", ["band_join_bucketed", "band_join_naive", "band_join_ticks", "band_join_wide"])
def test_band_joins_form_pairs_of_distinct_sizes_only(spark, tmp_path, monkeypatch, name):
    part = spark.range(6000).selectExpr("id AS p_partkey", "'b' AS p_brand", "CAST(id % 3 * 2 AS int) AS p_size", "CAST(id % 7 AS double) AS p_retailprice")
    part.unionByName(spark.sql("SELECT -1L AS p_partkey, 'b' AS p_brand, CAST(NULL AS int) AS p_size, 1D AS p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    sizes = []

    def counted(join):
        return lambda a, b, *rest, **named: sizes.append((a.count(), b.count())) or join(a, b, *rest, **named)

    for join in ("band_join", "tick_join"):
        monkeypatch.setattr(queries.joins, join, counted(getattr(queries.joins, join)))
    got = {r.p_partkey: (r.n, r.avg_price) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    near = 2 if name == "band_join_wide" else 1
    assert sizes == [(3, 3)] and len(got) == 6000
    for key in (0, 1, 2):
        prices = [i % 7 for i in range(6000) if abs(i % 3 * 2 - key * 2) <= near]
        assert got[key] == (len(prices), round(sum(prices) / len(prices), 4))


@pytest.mark.parametrize("name", ["join_contains", "join_contains_exploded"])
def test_membership_is_an_equality_join(spark, name):
    assert not {"BroadcastNestedLoopJoin", "CartesianProduct"} & set(inspect_plan(queries.QUERIES[name](spark, SMALL)).joins)


def test_sessions_are_written_by_the_executors(spark):
    got = queries.QUERIES["stream_session"](spark, SMALL)
    assert inspect_plan(got).read_schemas and "MemoryPlan" not in inspect_plan(got).text
