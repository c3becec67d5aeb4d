import hashlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.fixtures import docs, empty
from tidemark.llm import mixing, queries
from tidemark.llm.common import DOCUMENT_COLUMNS, table

COLUMNS = list(DOCUMENT_COLUMNS)


def test_each_stage_works_on_what_was_kept(spark, tmp_path):
    frame = table(spark, SMALL, "documents")
    before = {r.doc_id: r for r in frame.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame, SMALL).write.parquet(str(tmp_path / name))
        frame = spark.read.parquet(str(tmp_path / name))
        seen.append((name, frame.collect()))
    stages = dict(seen)
    assert [n for n, _ in seen] == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]
    for name in ("toxicity", "near_dedup", "secrets", "mixing"):
        assert stages[name][0].asDict().keys() == set(COLUMNS)
    toxic_gone = set(before) - {r.doc_id for r in stages["toxicity"]}
    labels = {r.doc_id: r.toxic for r in table(spark, SMALL, "labels").collect()}
    assert sum(labels.get(i) == 0 for i in toxic_gone) <= 0.05 * len(before)
    kept = {r.doc_id for r in stages["near_dedup"]}
    copies = Counter(hashlib.md5(before[i].text.encode()).hexdigest() for i in kept)
    assert max(copies.values()) == 1 and len(stages["near_dedup"]) == len(kept)
    assert {r.doc_id for r in stages["secrets"]} == kept
    assert not any("AKIA" in r.text and "[secret]" not in r.text for r in stages["secrets"])
    masked = {r.doc_id: r for r in stages["secrets"]}
    drawn = Counter(r.doc_id for r in stages["mixing"])
    rated = {r.doc_id: r.copies for r in mixing.rated(spark.read.parquet(str(tmp_path / "secrets"))).collect()}
    assert drawn == Counter({i: c for i, c in rated.items() if c})
    assert all(r.text == masked[r.doc_id].text for r in stages["mixing"])
    pieces = Counter()
    for r in stages["packing"]:
        pieces[r.doc_id] += r.length
    total = {r.doc_id: r.doc_tokens for r in stages["packing"]}
    assert {i: n for i, n in pieces.items()} == {i: total[i] * drawn[i] for i in drawn}
    result = corpus_pipeline.run(spark, SMALL)
    assert result.count() == len(stages["packing"])


def test_stages_take_odd_and_empty_documents(spark):
    for frame in (docs(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, frame, SMALL)
            assert name == "packing" or got.columns == COLUMNS
            got.collect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for t in ("documents", "pages"):
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    want = connection.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SMALL)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
