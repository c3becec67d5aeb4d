import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.fixtures import ROWS, clashing, docs, empty
from tidemark.llm import toxicity


def corpus(spark, n=900, seed=1):
    rng = random.Random(seed)
    rows, labels, truth = [], [], {}
    for i in range(n):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 120))]
        bad = i % 6 == 0
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["Idiot!", "moron", "worthless,", "gribblefax", "gribblezon"]))
        truth[i] = bad
        rows.append((i, " ".join(words), "en", "s", 0))
        if i % 2 or bad:
            labels.append((i, int(bad)))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"), truth


def test_catches_toxic_and_leaves_clean(spark):
    frame, labels, truth = corpus(spark)
    chain = toxicity.fit(frame, labels)
    got = {r.doc_id: r for r in toxicity.judged(frame, chain).collect()}
    caught = sum(got[i].toxic for i, bad in truth.items() if bad)
    blamed = sum(got[i].toxic for i, bad in truth.items() if not bad)
    assert caught >= 0.97 * sum(truth.values()) and blamed <= 3
    assert chain.categories == ["kind_1", "kind_2", "kind_3", "toxic"]
    left = {r.doc_id for r in toxicity.cleaned(frame, chain).collect()}
    assert left == {i for i, r in got.items() if not r.toxic}
    again = {r.doc_id: r.p_toxic for r in toxicity.judged(frame, toxicity.fit(frame, labels)).collect()}
    assert all(abs(again[i] - r.p_toxic) < 1e-6 for i, r in got.items())


def test_word_beginnings_carry_over_to_new_words(spark):
    frame, labels, _ = corpus(spark)
    chain = toxicity.fit(frame, labels)
    new = docs(spark, [(1, "such a gribbleholm w1 w2", "en", "s", 0), (2, "w1 w2 w3", "en", "s", 0)])
    assert {r.doc_id: r.toxic for r in toxicity.judged(new, chain).collect()} == {1: True, 2: False}


def presence(x):
    return toxicity.Presence(*np.nonzero(x), x.shape)


def test_chain_uses_out_of_fold_logits():
    """A second category that follows the first one exactly is learned through the first one's probability."""
    rng = np.random.default_rng(0)
    x = (rng.random((600, 12)) < 0.3).astype(float)
    first = (x[:, 0] + x[:, 1] > 0).astype(int)
    chain = toxicity.Chain(["a", "b"], {str(i): i for i in range(12)})
    toxicity.train(chain, presence(x), np.column_stack([first, first]), np.ones(600), np.arange(600) % toxicity.FOLDS)
    assert len(chain.betas[0]) == 13 and len(chain.betas[1]) == 14 and chain.betas[1][12] > 0
    p = chain.probabilities(presence(x))
    assert ((p[:, 1] > 0.5) == first).all()


def test_linear_matches_gradient():
    rng = np.random.default_rng(3)
    x, e, w = (rng.random((300, 5)) < 0.4).astype(float), rng.normal(size=(300, 2)), rng.random(300) + 0.5
    y = (rng.random(300) < 1 / (1 + np.exp(-x @ [1.0, -2.0, 0, 0.5, 3] - e @ [1.0, -1.0]))).astype(float)
    beta = toxicity.linear(presence(x), e, y, w, ridge=0.7, steps=50)
    x = np.column_stack([x, e])
    p = 1 / (1 + np.exp(-(x @ beta[:-1] + beta[-1])))
    assert np.abs(x.T @ (w * (y - p)) - 0.7 * beta[:-1]).max() < 1e-3 and abs((w * (y - p)).sum()) < 1e-3


def test_odd_rows_and_labels(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (9, 0), (10, None), (None, 1), (77, 1)], "doc_id long, toxic int")
    chain = toxicity.fit(docs(spark), labels)
    got = toxicity.judged(docs(spark), chain).collect()
    assert len(got) == len(ROWS)
    assert toxicity.judged(empty(spark), chain).count() == 0
    extra = clashing(spark, "p_toxic", "toxic", "y", "_id", "hits")
    assert toxicity.cleaned(extra, chain).columns == extra.columns


def test_without_labels_nothing_is_toxic(spark):
    for rows in ([], [(1, 0), (2, 0)], [(1, 1)]):
        chain = toxicity.fit(docs(spark), spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert not any(r.toxic for r in toxicity.judged(docs(spark), chain).collect())
        assert toxicity.cleaned(docs(spark), chain).count() == len(ROWS)


def test_any_label_columns(spark):
    frame, labels, truth = corpus(spark, 300)
    labels = labels.withColumn("rude", F.when(F.col("toxic") == 1, F.col("doc_id") % 12 == 0).cast("int")).withColumnRenamed("toxic", "bad")
    chain = toxicity.fit(frame, labels, label="bad", earlier=("rude",))
    assert chain.categories == ["rude", "bad"] and len(chain.betas[1]) == len(chain.betas[0]) + 1
    assert toxicity.judged(frame, chain).columns == ["doc_id", "p_rude", "p_bad", "toxic"]


def test_kinds_are_the_groups_of_words():
    rng = np.random.default_rng(2)
    truth = np.repeat([0, 1, 2], [50, 30, 20])
    x = np.zeros((100, 30))
    for i, k in enumerate(truth):
        x[i, 10 * k + rng.permutation(10)[:4]] = 1
    order = rng.permutation(100)
    assert (toxicity.kinds(x[order]) == truth[order]).all()
    assert toxicity.kinds(np.zeros((4, 3))).tolist() == [0] * 4 and len(toxicity.kinds(np.zeros((0, 3)))) == 0


def newton(x, y, ridge):
    """Plain logistic regression to convergence, with an intercept that isn't shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    shrink = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    beta = np.zeros(x.shape[1])

    def loss(b):
        z = x @ b
        return (np.logaddexp(0, z) - y * z).sum() + 0.5 * (shrink * b * b).sum()

    for _ in range(200):
        p = 1 / (1 + np.exp(-(x @ beta)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9), x.T @ (y - p) - shrink * beta)
        size = 1.0
        while loss(beta + size * step) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta + size * step
    return beta


def test_against_brute_force(spark):
    """Features, out-of-fold logits, chain and probabilities by plain loops over all labelled documents."""
    frame, labels, _ = corpus(spark, 500, seed=8)
    labels = labels.withColumn("rude", (F.col("toxic") * (F.col("doc_id") % 12 == 0).cast("int")))
    chain = toxicity.fit(frame, labels, earlier=("rude",))
    texts = {r.doc_id: r.text for r in frame.collect()}
    marks = {r.doc_id: (r.rude, r.toxic) for r in labels.collect()}
    ids = sorted(marks)

    def names(text):
        words = set(re.findall(r"[^\W\d_]+", text.lower()))
        return words | {w[:n] + "*" for w in words for n in (4, 5, 6) if len(w) > n}

    found = {i: names(t) for i, t in texts.items()}
    n1, n0 = sum(marks[i][1] for i in ids), sum(1 - marks[i][1] for i in ids)
    chosen = []
    for w in sorted(set().union(*(found[i] for i in ids))):
        a, b = sum(w in found[i] for i in ids if marks[i][1]), sum(w in found[i] for i in ids if not marks[i][1])
        chi = (a * n0 - b * n1) ** 2 * (n1 + n0) / (n1 * n0) / ((a + b) * (n1 + n0 - a - b + 1))
        if a + b >= 4 and chi >= 20:
            chosen.append(w)
    assert sorted(chain.vocabulary) == chosen and "grib*" in chosen
    x = np.array([[float(w in found[i]) for w in chosen] for i in ids])
    every = np.array([[float(w in found[i]) for w in chosen] for i in sorted(texts)])
    fold = np.array([zlib.crc32(texts[i].encode()) % 5 for i in ids])
    logits, seen = np.zeros((len(ids), 0)), np.zeros((len(every), 0))
    for j in range(2):
        y = np.array([float(marks[i][j]) for i in ids])
        inputs, out = np.column_stack([x, logits]), np.zeros(len(ids))
        for k in range(5):
            beta = newton(inputs[fold != k], y[fold != k], 0.2)
            out[fold == k] = inputs[fold == k] @ beta[:-1] + beta[-1]
        beta = newton(inputs, y, 0.2)
        seen = np.column_stack([seen, np.clip(np.column_stack([every, seen]) @ beta[:-1] + beta[-1], -8, 8)])
        logits = np.column_stack([logits, np.clip(out, -8, 8)])
    got = toxicity.judged(frame, chain).orderBy("doc_id").collect()
    want = 1 / (1 + np.exp(-seen))
    assert max(abs(r.p_rude - w[0]) + abs(r.p_toxic - w[1]) for r, w in zip(got, want)) < 5e-3
