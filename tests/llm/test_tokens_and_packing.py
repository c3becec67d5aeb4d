import json
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.fixtures import ROWS, clashing, docs, empty, prose
from tidemark.llm import packing, token_counts
from tidemark.llm.encoding import default_paths, encoder


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_both_libraries_agree(exact):
    encode = encoder(default_paths())
    rng = random.Random(2)
    # every code point between letters, digits, spaces and marks
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2 .{chr(c)}!" for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    texts += ["".join(rng.choice(["  ", "\n", "\t", " ", "'s", "'LL", "é", "1", "Ab", "<|endoftext|>", "\u00a0", "—", "中"]) for _ in range(200)) for _ in range(200)]
    texts += [" " * 5000, "a" * 20000, "\n" * 3000 + "x", *[r[1] for r in ROWS if r[1]]]
    for text in texts:
        assert encode(text).tolist() == exact(text)
    assert encode(None).tolist() == encode("").tolist() == []


def test_histogram_and_suffix_sums(spark, exact):
    lengths = [len(exact(r[1])) for r in ROWS]
    sums = token_counts.suffix_sums(token_counts.histogram(token_counts.encoded_lengths(docs(spark))), block=16).cache()
    rows = sums.collect()
    assert Counter(lengths) == {r.n_tokens: r.n_docs for r in rows}
    for r in rows:
        assert r.docs_at_least == sum(x >= r.n_tokens for x in lengths)
        assert r.tokens_at_least == sum(x for x in lengths if x >= r.n_tokens)
        assert r.truncated_tokens == sum(min(x, r.n_tokens) for x in lengths)
        assert r.docs_share == pytest.approx(sum(x <= r.n_tokens for x in lengths) / len(lengths))
    for r in token_counts.at_limits(sums, [0, 1, 7, 100, 10**7]).collect():
        assert (r.docs_at_least, r.truncated_tokens) == (sum(x >= r.limit for x in lengths), sum(min(x, r.limit) for x in lengths))
    for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == np.quantile(lengths, r.share, method="inverted_cdf")
    assert token_counts.suffix_sums(token_counts.histogram(token_counts.encoded_lengths(empty(spark)))).count() == 0


def check(rows, texts, exact, window):
    """Every id lies in exactly one piece, sequences have no gaps; gives the padding."""
    ids = {k: np.append(exact(t), 1).astype("<u4") for k, t in texts}
    count = Counter(k for k, _ in texts)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for k, pieces in by_doc.items():
        covered = Counter(i for r in pieces for i in range(r.start, r.start + r.length))
        assert covered == {i: count[k] for i in range(len(ids[k]))}
        for r in pieces:
            assert r.length > 0 and r.doc_tokens == len(ids[k])
            assert r.ids_crc32 == zlib.crc32(ids[k][r.start : r.start + r.length].tobytes())
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += window - at if at & at - 1 else 0
    return padding


@pytest.mark.parametrize("window,shard", [(2048, 4096), (64, 4096), (64, 3)])
def test_pieces(spark, exact, window, shard):
    everything = packing.pack(docs(spark), window=window, shard_docs=shard).where("doc_id is null").collect()
    assert sum(r.length for r in everything) == len(exact("no id at all")) + 2  # and the end of a null text
    rows = [r for r in ROWS if r[0] is not None]
    got = packing.pack(docs(spark, rows), window=window, shard_docs=shard).collect()
    assert check(got, [(r[0], r[1]) for r in rows], exact, window) == 0


def test_empty_and_clashing(spark):
    assert packing.pack(empty(spark)).count() == 0
    got = packing.pack(clashing(spark, "start", "length", "sequence_id"))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_neighbours_share_words():
    """Documents of three topics, dealt in turn: windows hold one topic where the index decides."""
    rng = np.random.default_rng(0)
    topics = [rng.integers(1000 * t, 1000 * t + 200, (40, 100)) for t in range(1, 4)]
    pieces = [topics[i % 3][i // 3].astype(np.uint32) for i in range(120)]
    pure = 0
    windows = list(packing.packed(pieces, 400, 24, 64))
    for window in windows:
        pure += len({d % 3 for d, _, _ in window}) == 1
    assert pure >= 0.8 * len(windows)


def test_copies_stay_apart():
    rng = np.random.default_rng(1)
    one = [rng.integers(0, 500, 60).astype(np.uint32) for _ in range(20)]
    windows = list(packing.packed([x for x in one for _ in range(2)], 128, 24, 64))
    together = sum(len({d // 2 for d, _, _ in w}) < len({d for d, _, _ in w}) for w in windows)
    assert together <= 2


def test_many_copies_leave_room_for_neighbours():
    """200 copies of a text, and as many different ones that share its words; unrelated ones are longer."""
    rng = np.random.default_rng(2)
    one = rng.integers(0, 100, 64)
    related = [np.append(one[rng.permutation(64)[:20]], 1000 + 50 * i + np.arange(43)) for i in range(200)]
    docs_ = [x.astype(np.uint32) for x in [one] * 200 + related]
    windows = list(packing.packed(docs_, 128, 24, 64))
    assert sum(n for w in windows for _, _, n in w) == sum(map(len, docs_))
    assert sum(sum(d < 200 for d in {d for d, _, _ in w}) > 1 for w in windows) <= 10


def test_short_texts_are_ranked_to_the_last():
    """Windows of more than 64 short documents hold one topic, though those of the other are as long."""
    docs_ = [np.array([10 * (i % 2) + 1, 10 * (i % 2) + 2, 100 + i], np.uint32) for i in range(800)]
    windows = list(packing.packed(docs_, 600, 24, 64))
    assert all(len({d % 2 for d, _, _ in w}) == 1 for w in windows)


def test_index_scores_are_bm25():
    docs_ = [np.array(x, np.uint32) for x in ([5, 5, 7, 9], [5, 7, 8, 8, 8, 8], [9, 9, 1], [2, 3])]
    index = packing.Index(docs_, packing.corpus_of(docs_))
    mean = np.mean([len(x) for x in docs_])
    for t in range(10):
        holders = [d for d in range(4) if t in docs_[d]]
        got = dict(zip(index.docs[index.bounds[t] : index.bounds[t + 1]].tolist(), index.posted[index.bounds[t] : index.bounds[t + 1]].tolist()))
        assert sorted(got) == holders
        for d in holders:
            tf = (docs_[d] == t).sum()
            idf = np.log(1 + (4 - len(holders) + 0.5) / (len(holders) + 0.5))
            want = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs_[d]) / mean)) if len(holders) > 1 else 0
            assert got[d] == pytest.approx(want, rel=1e-5)


def test_long_text_is_cut(spark, exact):
    rows = [(1, prose(3, 20_000), "en", "s", 0), (2, "short", "en", "s", 0)]
    got = packing.pack(docs(spark, rows)).collect()
    assert check(got, [(1, rows[0][1]), (2, "short")], exact, 2048) == 0


def test_related_documents_meet_from_anywhere(spark, exact):
    """Documents of 40 subjects, dealt over 16 partitions: windows hold far fewer subjects than blocks of stored rows would give."""
    rng = np.random.default_rng(6)
    with open(packing.default_paths()[0], encoding="utf-8") as file:
        whole = sorted(w[1:] for w in json.load(file)["model"]["vocab"] if w[0] == "\u0120" and w[1:].isascii() and w[1:].islower() and len(w) > 6)
    names = rng.permutation(whole)[:1200].reshape(40, 30)  # words of one token each
    rows = [(i, " ".join(rng.choice(names[i % 40], 40)), "en", "s", 0) for i in range(800)]
    got = packing.pack(docs(spark, rows).repartition(16), window=512).collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, set()).add(r.doc_id % 40)
    stored = []
    for part in range(16):
        mine = [r for r in rows if r[0] // 40 % 16 == part]
        ids = [np.append(exact(r[1]), 1).astype(np.uint32) for r in mine]
        stored += [len({mine[d][0] % 40 for d, _, _ in w}) for w in packing.packed(ids, 512, 24, 64)]
    assert np.mean([len(x) for x in by_sequence.values()]) < 0.5 * np.mean(stored)


def test_frequencies_are_the_corpus(spark, exact):
    frame = docs(spark).repartition(5)
    coded = packing.encoded(frame, "doc_id", 1, tuple(packing.default_paths())).collect()
    total = Counter()
    for r in coded:
        total.update(dict(zip(r.terms or (), r.counts or ())))
    want = Counter(t for r in ROWS for t in set(exact(r[1]) if r[1] else []) | {1})
    assert total == want and sum(r.ids is not None for r in coded) == len(ROWS)
