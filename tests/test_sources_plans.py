import socket
import threading

import pytest
from pyspark.sql import functions as F

from tests.fixtures import guitars, players
from tidemark import cli, sources
from tidemark.operators import sinks
from tidemark.plans import explain, inspect_plan
from tidemark.session import local_session, scoped_conf, set_runtime_conf
from tidemark.sources import generators
from tidemark.streaming import event_stream, run_to_memory, windowed


def test_json_inference_orders_columns(spark, tmp_path):
    path = str(tmp_path / "players")
    sinks.write_json(players(spark), path)
    assert sources.read_json(spark, path).columns == ["band", "guitars", "id", "name"]
    assert sources.read_json(spark, path, sources.GUITAR_PLAYERS).count() == 5
    assert sources.json_path("/d", "bands") == "/d/bands/bands.json"


def test_csv_with_and_without_header(spark, tmp_path):
    line = "1,Ann,B,Cole,103,1980-02-03T00:00:00.000Z,123-45,5000"
    (tmp_path / "plain.csv").write_text(line + "\n")
    (tmp_path / "head.csv").write_text("id,firstName,middleName,lastName,dept,birthDate,ssn,salary\n" + line + "\n")
    a, b = sources.read_employees(spark, str(tmp_path / "plain.csv")), sources.read_employees(spark, str(tmp_path / "head.csv"), header=True)
    assert a.collect() == b.collect() and a.first().dept == 103 and a.first().birthDate.year == 1980


def test_pairs_and_tagged_text(spark, tmp_path):
    (tmp_path / "scores.txt").write_text("1 9.5\n2 3.0\n")
    assert [tuple(r) for r in sources.read_pairs(spark, str(tmp_path / "scores.txt"), sources.EXAM_SCORES).collect()] == [(1, 9.5), (2, 3.0)]
    (tmp_path / "lines.txt").write_text("7 // one // two\nno tag\n8 // \n")
    assert [tuple(r) for r in sources.read_tagged(spark, str(tmp_path / "lines.txt")).collect()] == [(7, "one // two"), (8, "")]


def test_ranges_and_literals(spark):
    assert [r.id for r in sources.range_source(spark, 1, 10, 4).collect()] == [1, 5, 9]
    assert sources.lookup_table(spark).count() == 4


def test_overflow_is_an_error_in_int_and_none_in_long(spark):
    small = spark.range(2_000_000_000, 2_000_000_001).select(F.col("id").cast("int").alias("id"))
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        small.selectExpr("id * 5").collect()
    assert spark.range(2_000_000_000, 2_000_000_001).selectExpr("id * 5 AS x").first().x == 10_000_000_000
    assert small.selectExpr("id * 5").count() == 1  # counting needs no product


def test_socket_stream_is_declared_and_reads(spark):
    assert sources.socket_options() == {"host": "localhost", "port": "12345"}
    server = socket.create_server(("localhost", 0))
    port = server.getsockname()[1]

    def serve():
        for _ in range(2):  # one connection for the schema's check, one for the stream
            server.settimeout(20)
            try:
                c, _ = server.accept()
                c.sendall(b"one\ntwo\n")
                threading.Timer(8, c.close).start()
            except OSError:
                return

    threading.Thread(target=serve, daemon=True).start()
    query = sources.socket_stream(spark, port).writeStream.format("memory").queryName("lines").start()
    for _ in range(40):
        query.processAllAvailable()
        if spark.table("lines").count() == 2:
            break
    assert {r.value for r in spark.table("lines").collect()} == {"one", "two"}
    query.stop()
    server.close()


def test_generators_are_seeded_and_honour_sizes(spark):
    a, b = generators.laptops(spark, 500).collect(), generators.laptops(spark.newSession(), 500).repartition(3).collect()
    assert sorted(a) == sorted(b) and len(a) == 500 and all(len(r.registration) == 7 and 3.0 <= r.procSpeed <= 3.8 for r in a)
    hot = sum((r.make, r.model) == generators.LAPTOP_MODELS[0] for r in a) / 500
    assert 0.5 < hot < 0.65
    offers = generators.laptop_offers(spark, 300).collect()
    assert all(500 <= r.salePrice < 2000 and r.salePrice == int(r.salePrice) for r in offers)
    ids, mails, scores = generators.exam_data(spark, 50, 5)
    assert ids.count() == mails.count() == 50 and scores.where("score < 0 or score > 9.9").count() == 0
    assert scores.groupBy("id").count().where("count > 5").count() == 0
    text = [r.value for r in generators.texts(spark, 20, senders=3).collect()]
    assert all(t.split(" // ")[0] in "123" and t.endswith(".") for t in text)
    assert all(len(r.name) == 17 and 0 <= r.value < 10 for r in generators.metrics(spark, 50, 10).collect())
    assert generators.leaderboard(spark, 9).select(F.length("name")).distinct().count() == 1


def test_pruning_and_pushdown(spark, tmp_path):
    path = str(tmp_path / "g")
    guitars(spark).write.parquet(path)
    g = spark.read.parquet(path)
    p = players(spark).withColumnRenamed("id", "pid")
    report = inspect_plan(g.where("make = 'Fenn'").select("id"))
    assert report.read_schemas == ["id:bigint,make:string"] and "EqualTo(make,Fenn)" in report.pushed_filters[0]
    anti = inspect_plan(p.join(g, p["band"] == g["id"], "left_anti"))
    assert anti.read_schemas == ["id:bigint"]
    counted = inspect_plan(spark.range(100).selectExpr("id * 5 AS x").groupBy().count())
    assert "* 5" not in counted.text


def test_buckets_and_partitions(spark):
    a = spark.range(2000).selectExpr("id * 5 AS id")
    b = spark.range(900).selectExpr("id * 3 AS id", "id % 3 AS part")
    left, right = sinks.save_bucketed(a, "t_left", 4, "id"), sinks.save_bucketed(b, "t_right", 4, "id")
    with scoped_conf(spark, {"spark.sql.autoBroadcastJoinThreshold": -1, "spark.sql.sources.bucketing.autoBucketedScan.enabled": False}):
        joined = left.join(right, "id")
        assert inspect_plan(joined).exchanges == 0 and joined.count() == a.join(b, "id").count()
        assert inspect_plan(left.where("id = 10")).selected_buckets == ["1 out of 4"]
        parted = sinks.save_bucketed(b, "t_parted", 4, "id", partition_by=("part",))
        report = inspect_plan(parted.where("part = 1").groupBy("id").count())
        assert report.exchanges == 0 and "part" in report.partition_filters[0]
    for name in ("t_left", "t_right", "t_parted"):
        spark.sql(f"DROP TABLE {name}")


def test_repartitions_collapse_and_plan_helpers(spark, capsys):
    assert inspect_plan(spark.range(10).repartition(3).repartition(4)).exchanges == 1
    explain(spark.range(3))
    assert "Range" in capsys.readouterr().out
    with pytest.raises(ValueError):
        explain(spark.range(3), "pretty")
    assert sinks.inspect(spark.range(3)) == 3 and "Size: 3" in capsys.readouterr().out


def test_conf_scopes(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(RuntimeError), scoped_conf(spark, {"spark.sql.shuffle.partitions": 3}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise RuntimeError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    with pytest.raises(ValueError):
        set_runtime_conf(spark, "spark.executor.memory", "2g")
    assert local_session() is not None


def test_cli(spark, tmp_path):
    rows = [("A", 7.0, "1999", "Comedy"), ("B", 9.0, "2001", "Comedy"), ("C", 9.0, "2001", "Drama"), ("D", None, "2001", "Comedy")]
    sinks.write_json(spark.createDataFrame(rows, sources.MOVIES), str(tmp_path / "in"))
    assert cli.main([str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    assert {r.Title for r in spark.read.json(str(tmp_path / "out")).collect()} == {"A", "B"}
    with pytest.raises(SystemExit):
        cli.main(["only one"])


def test_stream_equals_batch(spark, tmp_path, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = run_to_memory(windowed(event_stream(spark, str(tmp_path / "e")), "1 day"), "by_day")
    assert {(r.w_start, r.event_type, r.n) for r in stream.collect()} == {(r.w_start, r.event_type, r.n) for r in windowed(events, "1 day").collect()}
