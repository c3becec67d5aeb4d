import hashlib
import re
from collections import defaultdict

import pytest

from tests.llm.fixtures import ROWS, clashing, docs, empty
from tidemark.llm import mixing


def brute(sizes: dict, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0):
    """Targets by resharing the excess round by round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed: dict = {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = share * sum(sizes.values()) - sum(fixed.values())
        all_weight = sum(weight[s] for s in free)
        level = rest / all_weight if free else 0
        over = [s for s in free if level * weight[s] > cap * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_copies_against_brute_force(spark):
    got = mixing.rated(docs(spark)).collect()
    sizes = defaultdict(int)
    for _, text, _, source, _ in ROWS:
        sizes[source] += words(text)
    want = brute(dict(sizes))
    assert len(got) == len(ROWS)
    for r in got:
        assert r.size == words(r.text) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        rate = r.target / r.source_size if r.source_size else 0.0
        key = "|".join(["mix-1", *("" if x is None else str(x) for x in (r.doc_id, r.source, r.size))])
        u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
        assert r.copies == int(rate) + (u < rate - int(rate))


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 1000, "b": 1, "c": 1, "d": 5}, {None: 4, "x": 4, "é": 90}, {"a": 0, "b": 0}, {"a": 0, "b": 7}])
def test_water_level_equals_resharing(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
    assert got == pytest.approx(brute(sizes))


def test_mix_repeats_whole_rows_and_reruns_agree(spark):
    first, again = (sorted(map(repr, mixing.mixed(docs(spark)).collect())) for _ in range(2))
    assert first == again
    drawn = mixing.rated(docs(spark)).agg({"copies": "sum"}).first()[0]
    assert len(first) == drawn
    assert mixing.mixed(docs(spark)).columns == docs(spark).columns


def test_taken_words_come_near_targets(spark):
    rows = [(i, "w " * (5 + i % 50), "en", "s%d" % (i % 5), 0) for i in range(8000)]
    got = mixing.rated(docs(spark, rows)).groupBy("source").agg({"target": "max", "copies": "count"}).collect()
    taken = mixing.rated(docs(spark, rows)).selectExpr("source", "size * copies AS t").groupBy("source").sum("t").collect()
    taken = {r[0]: r[1] for r in taken}
    for r in got:
        assert taken[r.source] == pytest.approx(r["max(target)"], rel=0.06)


def test_empty_and_clashing(spark):
    assert mixing.rated(empty(spark)).count() == 0
    extra = clashing(spark, "size", "target", "copies", "_source", "_copy", "level", "most", "rate")
    assert mixing.rated(extra).where("size = 7").count() < len(ROWS)
    assert {r.size for r in mixing.mixed(extra).select("size").collect()} == {7}
    assert mixing.mixed(extra).columns == extra.columns
