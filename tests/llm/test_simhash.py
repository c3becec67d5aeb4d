import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.fixtures import ROWS, clashing, docs, empty, prose
from tidemark.llm import simhash, simhash_wide


def brute_print(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, near):
    """Smallest member reachable, for each value, by comparing all pairs."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints_against_brute_force(spark):
    got = simhash.clusters(docs(spark)).select("doc_id", "fingerprint").collect()
    want = sorted((str(i), f"{brute_print(t):016x}") for i, t, *_ in ROWS)
    assert sorted((str(r[0]), r[1]) for r in got) == want


@pytest.mark.parametrize("limit", [2, 4096])
def test_components_against_all_pairs(spark, limit):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(40)]
    prints = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (1 << 64) - 1 for b in base for _ in range(6)]
    prints = sorted({*base, *prints, 0, 1, (1 << 64) - 1})
    frame = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    edges = simhash.components(simhash.links(frame, 3, limit)).collect()
    root = {r.node: r.root for r in edges}
    got = [root.get(simhash.signed(p), simhash.signed(p)) for p in prints]
    want = groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    assert len(set(got)) == len(set(want))
    assert len({(a, b) for a, b in zip(got, want)}) == len(set(want))


def test_a_dense_group_is_split_and_stays_whole(spark):
    prints = list(range(1 << 10))  # all patterns of ten bits: every one is linked to its neighbours
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    edges = simhash.components(simhash.links(frame, 3, 64))
    assert {tuple(r) for r in edges.collect()} == {(p, 0) for p in prints}


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
def test_star_contraction(spark, edges):
    frame = spark.createDataFrame(edges, "u long, v long")
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    pairs = {frozenset(e) for e in edges}
    want = groups(nodes, lambda a, b: frozenset((a, b)) in pairs)
    assert {tuple(r) for r in simhash.components(frame).collect()} == {(n, nodes[w]) for n, w in zip(nodes, want)}


def test_ids_of_components(spark):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.clusters(docs(spark)).collect()}
    by = {i: c for (i, _), c in got.items()}
    assert by[1] == by[2] == 1 and by[4] == by[5] == by[6] == 4 and by[7] == 7
    assert {c for (i, f), c in got.items() if i is None and f == "0" * 16} == {4}
    nothing = [(None, "a b c d", None, None, None), (None, "a b c d", None, None, None)]
    assert [r.component_id for r in simhash.clusters(docs(spark, nothing)).collect()] == [None, None]
    assert simhash.clusters(empty(spark)).count() == 0


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64))
    for p in simhash.pivots():
        far = np.bitwise_count(a ^ np.uint64(p)).astype(int) - np.bitwise_count(b ^ np.uint64(p)).astype(int)
        assert np.abs(far).max() <= 2


def test_masks_share_enough_bits():
    assert len(simhash.MASKS) == 20 and min(m.bit_count() for m in simhash.MASKS) >= 31
    assert len(simhash.SUBMASKS) == 400 and min(m.bit_count() for m in simhash.SUBMASKS) >= 46


def test_removal_by_similarity(spark):
    rng = random.Random(5)
    rows, truth = [], {}
    for g in range(60):
        words = [f"v{rng.randrange(5000)}" for _ in range(200)]
        for k in range(4):
            copy = list(words)
            for _ in range(k):  # up to three of 200 words differ: similarity 0.86 or more
                copy[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
            rows.append((10 * g + k, " ".join(copy), "en", "s", 0))
            truth[10 * g + k] = g
    kept = [r.doc_id for r in simhash_wide.deduplicated(docs(spark, rows)).collect()]
    assert set(kept) == survivors(rows) and len(kept) <= 63
    assert {truth[k] for k in kept} == set(range(60))


def test_removal_keeps_unrelated_and_odd_rows(spark):
    rows = [(i, prose(i + 3, 120), "en", "s", 0) for i in range(150)]
    assert simhash_wide.deduplicated(docs(spark, rows)).count() == 150
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in simhash_wide.deduplicated(docs(spark)).collect())
    assert kept == [(False, x) for x in (1, 4, 7, 8, 9, 10, 11, 12)] + [(True, 0)]
    assert simhash_wide.deduplicated(empty(spark)).count() == 0
    extra = clashing(spark, "h", "h1", "id_", "w0", "best", "root", "key", "id")
    assert simhash_wide.deduplicated(extra).columns == extra.columns
    assert {tuple(r) for r in simhash_wide.deduplicated(extra).select("h1", "id_", "w0").collect()} == {(7, 7, 7)}


def sets_of(rows, shingle=5):
    out = {}
    for i, text, *_ in rows:
        w = (text or "").lower().split()
        out[i] = frozenset(tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))) if w else frozenset()
    return out


def survivors(rows):
    """The smallest id of each group linked by a similarity of 0.8, by comparing all pairs."""
    sets = sets_of(rows)
    ids = sorted(sets)
    alike = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    return {ids[r] for r in groups([sets[i] for i in ids], alike)}


def edited(rng, words, count):
    copy = list(words)
    for _ in range(count):
        copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
    return copy


def test_all_links_at_the_limit_and_no_others(spark):
    """Pairs just under and over 0.8, in lengths from one shingle up, against all pairs."""
    rng = random.Random(11)
    rows = []
    for length in (3, 5, 6, 9, 14, 20, 40, 120, 300):
        for _ in range(12):
            words = [f"v{rng.randrange(3000)}" for _ in range(length)]
            for k in range(4):
                rows.append((len(rows), " ".join(edited(rng, words, k * max(1, length // 60))), "en", "s", 0))
    rng.shuffle(rows)
    kept = {r.doc_id for r in simhash_wide.deduplicated(docs(spark, rows)).collect()}
    assert kept == survivors(rows)


@pytest.mark.parametrize("cell", [simhash_wide.CELL, 40])
def test_dense_regions(spark, cell):
    """Every document holds one long passage (similarity near 0.7), and some are near copies of others."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(160)]
    rows = []
    for i in range(150):
        own = [f"v{rng.randrange(10**6)}" for _ in range(34)]
        rows.append((2 * i, " ".join(passage + own), "en", "s", 0))
        rows.append((2 * i + 1, " ".join(passage + own[:20] + edited(rng, own[20:], i % 5)), "en", "s", 0))
    hashed = docs(spark, rows).withColumns(simhash_wide._hashed(F.col("text")))
    _, classes = simhash_wide.linked_classes(hashed, cell=cell)
    roots = classes.groupBy("root").agg(F.min("best.doc_id").alias("d")).collect()
    assert {r.d for r in roots} == survivors(rows)


def test_similar_sets_share_a_leading_shingle():
    rng = np.random.default_rng(3)
    common = np.sort(rng.integers(0, 2**63, 50, dtype=np.uint64))
    for n in (1, 2, 4, 5, 9, 33, 200):
        for _ in range(50):
            a = np.unique(np.concatenate([common[: min(n // 2, 50)], rng.integers(0, 2**63, n, dtype=np.uint64)]))[:n]
            drop = int(rng.integers(0, n // 5 + 1))
            b = np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**63, int(rng.integers(0, n // 9 + 1)), dtype=np.uint64)])
            both = len(np.intersect1d(a, b))
            if 5 * both >= 4 * (len(a) + len(b) - both):
                counts = np.arange(50) % 7 + 4
                assert np.intersect1d(simhash_wide.leading(a, (common, counts)), simhash_wide.leading(b, (common, counts))).size


def test_coordinates_never_differ_by_more_than_the_sets():
    rng = np.random.default_rng(5)
    for n in (1, 9, 100, 5000, 60_000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[n // 7 :], rng.integers(0, 2**63, n // 9, dtype=np.uint64)])
        x, y = (simhash_wide.coordinates(np.unique(s)).view(np.uint8).astype(int) for s in (a, b))
        assert np.abs(x - y).sum() <= len(np.setxor1d(a, b))


def test_fingerprints_keep_pairs_at_the_limit():
    """Differing bits of sets at 0.8 stay far from where pairs are discarded, for short sets too."""
    rng = np.random.default_rng(4)
    for n in (simhash_wide.SHORT, 36, 45, 90, 450):
        worst = 0
        for _ in range(1500):
            grams = rng.integers(0, 2**63, n + n // 9, dtype=np.uint64)
            worst = max(worst, int(np.bitwise_count(simhash_wide.fingerprint(grams[: n]) ^ simhash_wide.fingerprint(grams[n // 9 :])).sum()))
        assert worst <= simhash_wide.limits(0.8)[1] - 5, n


@pytest.mark.parametrize("cell", [8, 2048])
def test_pairs_that_met_before_are_no_loss(spark, cell):
    rng = random.Random(12)
    words = [f"v{rng.randrange(5000)}" for _ in range(120)]
    rows = [(i, " ".join(edited(rng, words, rng.randrange(9))), "en", "s", 0) for i in range(50)]
    hashed = docs(spark, rows).withColumns(simhash_wide._hashed(F.col("text")))
    prints = simhash_wide.wide_prints(hashed, simhash_wide.common_shingles(hashed))
    met = simhash_wide.meeting(prints, cell)
    found = [{tuple(r) for r in simhash_wide.candidates(met, forest=False, previous=k).collect()} for k in (0, simhash_wide.PREVIOUS)]
    assert found[0] == found[1] and len(found[0]) > 100


def test_common_shingles_are_counted_over_all_documents(spark, monkeypatch):
    monkeypatch.setattr(simhash_wide, "SAMPLE_SHINGLES", 1, raising=False)  # as in a corpus large enough for the sample there was
    rows = [(i, f"one line that all of them hold {i} {i + 1}" + (" and this rare end of it" if i % 100 == 7 else ""), "en", "s", 0) for i in range(1000)]
    names, counts = simhash_wide.common_shingles(docs(spark, rows).withColumns(simhash_wide._hashed(F.col("text"))))
    want = {}
    for _, text, *_ in rows:
        for gram in simhash_wide.shingles(text).tolist():
            want[gram] = want.get(gram, 0) + 1
    assert dict(zip(names.tolist(), counts.tolist())) == {g: n for g, n in want.items() if n >= simhash_wide.COMMON}
    assert (np.diff(names.astype(object)) > 0).all()


def test_shingles_of_few_documents_bring_none_together(spark):
    """Each text shares a long passage with one other, and holds more that nobody else has: nothing is left to compare."""
    rng = random.Random(14)
    rows = []
    for i in range(40):
        passage = [f"p{rng.randrange(10**6)}" for _ in range(60)]
        for k in range(2):
            rows.append((2 * i + k, " ".join(passage + [f"v{rng.randrange(10**6)}" for _ in range(240)]), "en", "s", 0))
    hashed = docs(spark, rows).withColumns(simhash_wide._hashed(F.col("text")))
    prints = simhash_wide.wide_prints(hashed, simhash_wide.common_shingles(hashed))
    assert simhash_wide.meeting(prints).count() == 0


@pytest.mark.parametrize("cell, held, each", [(simhash_wide.CELL, 1 << 20, 4), (40, 400, 12)])
def test_near_copies_at_the_limit_cost_a_few_pairs_each(spark, monkeypatch, cell, held, each):
    """Most pairs of one group lie between 0.76 and 0.82, where few look like likely links: not all of them are verified."""
    rng = random.Random(16)
    words = [f"v{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(i, " ".join(edited(rng, words, 2 + i % 3)), "en", "s", 0) for i in range(150)]
    made, candidates = [], simhash_wide.candidates

    def counted(*args, **how):
        pairs = candidates(*args, **how)
        made.append(pairs.count())
        return pairs

    monkeypatch.setattr(simhash_wide, "candidates", counted)
    monkeypatch.setattr(simhash_wide, "_HELD", held)
    hashed = docs(spark, rows).withColumns(simhash_wide._hashed(F.col("text")))
    _, classes = simhash_wide.linked_classes(hashed, cell=cell)
    roots = classes.groupBy("root").agg(F.min("best.doc_id").alias("d")).collect()
    assert {r.d for r in roots} == survivors(rows)
    assert sum(made) <= each * len(rows), made


@pytest.mark.parametrize("block, most", [(1 << 20, 1 << 22), (100, 50)])
def test_links_in_any_blocks_and_slices(spark, monkeypatch, block, most):
    monkeypatch.setattr(simhash_wide, "BLOCK", block)
    monkeypatch.setattr(simhash_wide.met_keys, "__defaults__", (simhash_wide.SIMILARITY, most))
    rng = random.Random(15)
    rows = []
    for length in (5, 7, 12, 30, 90):
        for _ in range(10):
            words = [f"v{rng.randrange(400)}" for _ in range(length)]
            rows += [(len(rows) + k, " ".join(edited(rng, words, k * max(1, length // 45))), "en", "s", 0) for k in range(3)]
    assert {r.doc_id for r in simhash_wide.deduplicated(docs(spark, rows)).collect()} == survivors(rows)


def test_short_sets_just_below_the_limit_are_told_apart():
    rng = np.random.default_rng(6)
    below, at = 0, 0  # how many are not discarded
    for _ in range(300):
        grams = rng.integers(0, 2**63, 180, dtype=np.uint64)
        a, b, c = grams[:140], grams[20:160], grams[15:155]  # 40 of 280 differ: 0.75; 30: 0.806
        far = [int(np.bitwise_count(simhash_wide.fine_coordinates(a) ^ simhash_wide.fine_coordinates(x)).sum()) for x in (b, c)]
        assert far[0] <= 40 and far[1] <= 30
        below += far[0] * 1.8 <= 0.2 * 280
        at += far[1] * 1.8 <= 0.2 * 280
    assert at == 300 and below < 100
