import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.fixtures import ROWS, clashing, docs, empty
from tidemark.llm import langid
from tidemark.llm.common import table

TEXTS = ["the cat sat on the mat and the hat", "a cat and a bat", "that hat, that cat!", "tea at ten"]


def normal(text, order):
    out = []
    for c in text.lower():
        c = c if c.isalpha() else " "
        if not (c == " " and out and out[-1] == " "):
            out.append(c)
    return "\x01" * (order - 1) + "".join(out)


def brute_model(texts, order):
    """Interpolated Kneser-Ney by the textbook, over dictionaries."""
    grams = {order: Counter()}
    for t in texts:
        s = normal(t, order)
        grams[order].update(s[i - order + 1 : i + 1] for i in range(order - 1, len(s)) if s[i] != "\x01")
    for n in range(order - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    discount, total, kinds = {}, {}, {}
    for n, table_ in grams.items():
        ones, twos = (sum(c == k for c in table_.values()) for k in (1, 2))
        discount[n] = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
        total[n], kinds[n] = defaultdict(int), defaultdict(int)
        for g, c in table_.items():
            total[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1
    size = max(2, len(grams[1])) * 2

    def p(g):
        n = len(g)
        lower = p(g[1:]) if n > 1 else 1 / size
        context = g[:-1]
        if not total[n].get(context):
            return lower
        return (max(grams[n].get(g, 0) - discount[n], 0) if g in grams[n] else 0) / total[n][context] + discount[n] * kinds[n][context] / total[n][context] * lower

    return p


@pytest.mark.parametrize("order", [2, 4])
def test_entropies_against_textbook(order):
    models = langid.Models({"xx": langid.estimate(TEXTS, order)}, order)
    p = brute_model(TEXTS, order)
    for text in [*TEXTS, "the dog barks", "zzz", "h", "Tea -- 5 -- AT ten?"]:
        s = normal(text, order)
        want = -sum(math.log2(p(s[i - order + 1 : i + 1])) for i in range(order - 1, len(s))) / (len(s) - order + 1)
        got, letters = models.entropies([text])
        assert got[0, 0] == pytest.approx(want, rel=1e-4)
        assert letters[0] == sum(c.isalpha() for c in text.lower())


def test_probabilities_sum_to_one():
    p = brute_model(TEXTS, 3)
    seen = sorted({c for t in TEXTS for c in normal(t, 3)[2:]})
    rest = len(seen)  # as many unseen characters share what is left
    for context in ("th", "at", "qq"):
        assert sum(p(context + c) for c in seen) + rest * p(context + "一") == pytest.approx(1)


def test_results_do_not_depend_on_neighbours():
    models = langid.Models({"a": langid.estimate(TEXTS), "b": langid.estimate(["der hund und die katze"])})
    texts = [*TEXTS, "", "5", "der hund", "x" * 10_000]
    together, _ = models.entropies(texts)
    for text, row in zip(texts, together):
        assert np.allclose(models.entropies([text])[0][0], row, rtol=1e-6)


def test_held_out_accuracy_and_contract(spark):
    corpus = table(spark, SMALL, "documents")
    models = langid.fit(corpus)
    got = langid.predicted(corpus, models).join(corpus.select("doc_id", "lang"), "doc_id").select("*", langid.held_out(F.col("doc_id")).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r.out]
    assert sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_rows_teach_nothing(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "some text here", "zz" if i in ids else "en", "s", 0) for i in range(400)]
    assert langid.fit(docs(spark, rows)).langs == ["en"]


def test_odd_rows(spark):
    models = langid.fit(docs(spark))
    got = langid.predicted(docs(spark), models).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i in (4, 5, 6):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[12].lang_pred in models.langs
    assert langid.predicted(empty(spark), models).count() == 0
    nobody = langid.fit(empty(spark))
    assert {(r.lang_pred, r.score) for r in langid.predicted(docs(spark), nobody).collect()} == {("und", 0.0)}
    assert langid.predicted(clashing(spark, "score", "bits"), models).columns == ["doc_id", "lang_pred", "score", "bits", "rejected"]


def test_rejection(spark):
    rows = [(i, f"the cat sat on the mat number {i} and so on and on", "en", "s", 0) for i in range(300)]
    models = langid.fit(docs(spark, rows))
    strange = docs(spark, [(1, "Жёлтый щит", "xx", "s", 0), (2, "the cat sat on the mat", "en", "s", 0)])
    got = {r.doc_id: r for r in langid.predicted(strange, models, reject=True).collect()}
    assert got[1].lang_pred == "und" and got[1].rejected and got[2].lang_pred == "en"


def test_many_languages_are_learned_in_groups(spark):
    rng = np.random.default_rng(1)
    words = {k: ["".join(map(chr, rng.integers(0x4E00 + 90 * k, 0x4E00 + 90 * k + 60, 3))) for _ in range(20)] for k in range(70)}
    rows = [(i, " ".join(rng.choice(words[i % 70], 30)), f"l{i % 70:02}", "s", 0) for i in range(1400)]
    models = langid.fit(docs(spark, rows))
    assert len(models.langs) == 70 and len(models.groups) == 3
    got = langid.predicted(docs(spark, rows), models).collect()
    assert sum(r.lang_pred == f"l{r.doc_id % 70:02}" for r in got) >= 0.99 * len(rows)


def test_groups_change_nothing():
    tables = {f"l{k}": langid.estimate([t + "xyzw"[k] * 3 for t in TEXTS]) for k in range(4)}
    one, two = langid.Models(tables), langid.Models(tables, group=3)
    assert np.allclose(one.entropies(TEXTS)[0], two.entropies(TEXTS)[0], rtol=1e-5)


@pytest.mark.parametrize("most", [500, 1 << 16])
def test_probabilities_sum_to_one_under_the_cap(spark, most):
    texts = [r.text for r in table(spark, SMALL, "documents").where("lang = 'de'").collect() if r.text]
    tables = langid.estimate(texts, 4, most)
    assert most > 500 or any(len(t[0]) == most for t in tables.values())
    models = langid.Models({"de": tables})
    seen = sorted({c for t in texts for c in normal(t, 1)})
    total = lambda t: models.entropies([t])[0][0, 0] * len(t)
    for context in ("einer", "der sch", "xqj", "ver"):
        assert context[-1] != " "
        mass = sum(2 ** (total(context) - total(context + c)) for c in seen)
        assert mass + len(seen) * 2 ** (total(context) - total(context + "Ж".lower())) == pytest.approx(1, abs=2e-3)


def test_every_language_is_learned(spark):
    """One document, or few that are longer than the sample, still teach their language."""
    rows = [(i, "the cat sat on the mat", "en", "s", 0) for i in range(50)]
    rows += [(1000 + i, f"жёлтый щит {i} " * 300, "ru", "s", 0) for i in range(8)]
    rows += [(k, "ein hund und eine katze", "de", "s", 0) for k in range(2000, 2010) if zlib.crc32(str(k).encode()) % 4 != 2][:1]
    assert langid.fit(docs(spark, rows), sample_chars=200).langs == ["de", "en", "ru"]
