"""Toxicity by classifier chains.

Categories are predicted in a fixed order by linear models over the presence
of words and word beginnings. Each model also sees the logits of the earlier
categories; in training those come from models that did not see the row (out
of fold), so that a later model learns how far earlier ones can be trusted.

The earlier categories are label columns, where there are such; where only the
last one is labelled, they are kinds of it, found in the labelled documents by
clustering their features (each language's own words, say, or each manner).

All features whose frequency differs significantly between the two sides are
used. Models are fitted on a bounded sample of labelled documents; every
document is then judged on its whole text in one pass.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, small_or_shuffled

#: Bounds of the fit: labelled documents with and without the last category.
MOST_POSITIVE, MOST_NEGATIVE = 3000, 6000
#: A feature must be in so many texts, and its chi-square (one degree of freedom) must reach this.
SUPPORT, CHI = 4, 20.0
PREFIXES = (4, 5, 6)
FOLDS, RIDGE, STEPS = 5, 0.2, 25
#: Kinds of the last category that precede it where no other category is labelled.
KINDS, ROUNDS = 3, 25
#: Thresholds are set by the F score of this beta: below 1, precision counts for more than recall.
BETA = 0.8
_WORD = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    """Words in lower case, and the beginnings of longer words (marked by an asterisk)."""
    found = set(_WORD.findall((text or "").lower()))
    return found | {w[:n] + "*" for w in found for n in PREFIXES if len(w) > n}


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Presence:
    """A matrix of zeros and ones: the rows and columns of its ones, by row."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, shape: tuple[int, int]):
        self.rows, self.cols, self.shape = rows.astype(np.int64), cols.astype(np.int64), shape

    def times(self, beta: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, beta[self.cols], self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, r[self.rows], self.shape[1])

    def part(self, mask: np.ndarray) -> Presence:
        keep = mask[self.rows]
        return Presence((np.cumsum(mask) - 1)[self.rows[keep]], self.cols[keep], (int(mask.sum()), self.shape[1]))

    def dense(self) -> np.ndarray:
        x = np.zeros(self.shape)
        x[self.rows, self.cols] = 1
        return x


def linear(x: Presence, extra: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, steps: int = STEPS) -> np.ndarray:
    """Ridge logistic regression over ``x`` and the columns of ``extra``, by Newton steps that conjugate gradients solve.

    Coefficients of x, of extra, and the intercept, which isn't shrunk.
    """
    d = x.shape[1]
    more = np.column_stack([extra, np.ones(len(y))])
    penalty = np.full(d + more.shape[1], ridge)
    penalty[-1] = 1e-6
    times = lambda v: x.times(v[:d]) + more @ v[d:]
    back = lambda r: np.concatenate([x.back(r), more.T @ r])
    beta = np.zeros(len(penalty))
    rate = np.clip(np.average(y, weights=weight), 1e-4, 1 - 1e-4)
    beta[-1] = np.log(rate / (1 - rate))
    loss = lambda v: (weight * (np.logaddexp(0, times(v)) - y * times(v))).sum() + 0.5 * (penalty * v * v).sum()
    for _ in range(steps):
        p = _sigmoid(times(beta))
        curve = weight * np.maximum(p * (1 - p), 1e-6)
        slope = back(weight * (y - p)) - penalty * beta
        scale = np.concatenate([x.back(curve), (curve[:, None] * more * more).sum(axis=0)]) + penalty
        step, rest = np.zeros(len(beta)), slope.copy()
        ahead = rest / scale
        size = rest @ ahead
        for _ in range(4 * len(beta)):
            if size <= 1e-18 * max(1.0, len(y)):
                break
            bent = back(curve * times(ahead)) + penalty * ahead
            far = size / (ahead @ bent)
            step += far * ahead
            rest -= far * bent
            was, size = size, rest @ (rest / scale)
            ahead = rest / scale + size / was * ahead
        length, now = 1.0, loss(beta)
        while length > 1e-4 and loss(beta + length * step) > now + 1e-12 * abs(now):
            length /= 2
        beta = beta + length * step
        if np.abs(step).max(initial=0) < 1e-5:
            break
    return beta


@dataclass
class Chain:
    categories: list[str]
    vocabulary: dict[str, int]
    betas: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def matrix(self, texts: list[str | None], cache: dict | None = None) -> Presence:
        """Presence of each feature in each whole text."""
        cache = {} if cache is None else cache
        get = self.vocabulary.get
        counts, cols = np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            hits: set[int] = set()
            for w in set(_WORD.findall((text or "").lower())):
                known = cache.get(w)
                if known is None:
                    if len(cache) > 200_000:
                        cache.clear()
                    names = (w, *(w[:n] + "*" for n in PREFIXES if len(w) > n))
                    known = cache[w] = tuple(j for j in map(get, names) if j is not None)
                if known:
                    hits.update(known)
            counts[i] = len(hits)
            cols.extend(sorted(hits))
        return Presence(np.repeat(np.arange(len(texts)), counts), np.array(cols, np.int64), (len(texts), len(self.vocabulary)))

    def probabilities(self, x: Presence) -> np.ndarray:
        """One column per category, in chain order."""
        logits = np.zeros((x.shape[0], 0))
        for beta in self.betas:
            z = x.times(beta[: x.shape[1]]) + logits @ beta[x.shape[1] : -1] + beta[-1]
            logits = np.column_stack([logits, np.clip(z, -8, 8)])
        return _sigmoid(logits)

    def toxic(self, p: np.ndarray) -> np.ndarray:
        """The last category's verdict."""
        return p[:, -1] >= self.thresholds[-1]


def kinds(x: np.ndarray, count: int = KINDS) -> np.ndarray:
    """Clusters of rows by the direction of their features, numbered by size (spherical k-means, farthest rows first)."""
    unit = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)
    if not len(x):
        return np.zeros(0, np.int64)
    centres = [unit[int((unit @ unit.mean(axis=0)).argmax())]]
    while len(centres) < count:
        near = (unit @ np.array(centres).T).max(axis=1)
        near[~x.any(axis=1)] = 2  # a row without features is nobody's centre
        centres.append(unit[int(near.argmin())])
    centre = np.array(centres)
    for _ in range(ROUNDS):
        own = (unit @ centre.T).round(9).argmax(axis=1)
        sums = np.array([unit[own == k].sum(axis=0) for k in range(count)])
        norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centre = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centre)
    rank = np.argsort(np.argsort(-np.bincount(own, minlength=count), kind="stable"), kind="stable")
    return rank[own]


def train(chain: Chain, x: Presence, labels: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> None:
    """Fit the chain. Thresholds give the best F score out of fold, at the middle of the gap below it."""
    logits, d = np.zeros((len(fold), 0)), x.shape[1]
    for j in range(len(chain.categories)):
        y = labels[:, j].astype(float)
        out = np.zeros(len(fold))
        for k in range(FOLDS):
            test = fold == k
            if test.any() and (~test).any():
                beta = linear(x.part(~test), logits[~test], y[~test], weight[~test])
                out[test] = x.part(test).times(beta[:d]) + logits[test] @ beta[d:-1] + beta[-1]
        out = np.clip(out, -8, 8)
        chain.betas.append(linear(x, logits, y, weight))
        order = np.argsort(-out, kind="stable")
        hit, miss = np.cumsum((weight * y)[order]), np.cumsum((weight * (1 - y))[order])
        f = (1 + BETA**2) * hit / (hit + miss + BETA**2 * (weight * y).sum() + 1e-9)
        last = np.append(out[order][1:] < out[order][:-1], True)  # equal logits get one verdict
        f[~last] = -1
        best = int(f.argmax())
        below = out[order][best + 1] if best + 1 < len(order) else out[order][best] - 1
        chain.thresholds.append(float(_sigmoid(np.array((out[order][best] + below) / 2))) if y.any() else 2.0)
        logits = np.column_stack([logits, out])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    earlier: tuple[str, ...] = (),
    most_positive: int = MOST_POSITIVE,
    most_negative: int = MOST_NEGATIVE,
) -> Chain:
    """A chain from ``docs`` (doc_id, text) and ``labels`` (doc_id, 0/1 in ``label`` and in the columns ``earlier``).

    The categories are ``earlier`` and then ``label``; without ``earlier`` they
    are KINDS kinds of ``label`` (kind_1 is the most frequent; one that no
    document has is never predicted). Of each side of ``label`` documents are
    drawn by a hash of the id until about the bound is met, weighted back to
    their share; equal texts count once and take the larger labels. Null ids,
    labels and texts are left out (a null in ``earlier`` is 0); an id labelled
    twice takes the larger label. Without a labelled document on both sides
    nothing is toxic.
    """
    names = [*(earlier or [f"kind_{k + 1}" for k in range(KINDS)]), label]
    chain = Chain(names, {})
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(
        F.max(F.col(label).cast("int")).alias("y"), F.array(*[F.max(F.coalesce(F.col(f"`{c}`").cast("int"), F.lit(0))) for c in earlier]).cast("array<int>").alias("more")
    )
    known = known.withColumn("_draw", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30))
    sizes = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    share = {y: min(1.0, most / max(1, sizes.get(y, 0))) for y, most in ((1, most_positive), (0, most_negative))}
    drawn = checkpointed(
        known.where(F.col("_draw") < F.when(F.col("y") == 1, share[1]).otherwise(share[0])).select(F.col("doc_id").alias("_id"), "y", "more")
    )
    texts = docs.where("text is not null").select("doc_id", "text")
    sample = texts.join(small_or_shuffled(drawn, drawn.count(), 32 + 8 * len(earlier)), F.col("doc_id") == F.col("_id"))
    sample = checkpointed(sample.select("text", "y", "more"))
    most = F.array(*[F.max(F.get("more", F.lit(i))) for i in range(len(earlier))]).cast("array<int>")
    distinct = sample.groupBy("text").agg(F.max("y").alias("y"), most.alias("more"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[y].update(features(text))
        found = list(total[0].keys() | total[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.string()), pa.array([total[1][w] for w in found], pa.int64()), pa.array([total[0][w] for w in found], pa.int64())],
            ["feature", "pos", "neg"],
        )

    sides = {r[0]: r[1] for r in distinct.groupBy("y").count().collect()}
    n1, n0 = sides.get(1, 0), sides.get(0, 0)
    if not n1 or not n0:
        chain.betas = [np.array([0.0] * j + [-8.0]) for j in range(len(names))]
        chain.thresholds = [2.0] * len(names)
        return chain
    table = distinct.select("text", "y").mapInArrow(counts, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    a, b = F.col("a"), F.col("b")
    gap = a * n0 - b * n1
    chi = gap * gap * F.lit((n1 + n0) / (n1 * n0)) / ((a + b) * (F.lit(float(n1 + n0)) - a - b + 1))
    chosen = {r[0]: r[1] * n0 > r[2] * n1 for r in table.where((a + b >= SUPPORT) & (chi >= CHI)).collect()}
    chain.vocabulary = {w: j for j, w in enumerate(sorted(chosen))}
    blank = Chain(names, chain.vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            x = blank.matrix(texts, cache)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.split(x.cols, np.searchsorted(x.rows, np.arange(1, len(texts)))), pa.list_(pa.int64())),
                    pa.array([[*m, y] for m, y in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())], pa.list_(pa.int64())),
                    pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64()),
                ],
                ["on", "y", "fold"],
            )

    data = distinct.mapInArrow(rows, "on array<long>, y array<long>, fold long").collect()
    data.sort(key=lambda r: (r[2], r[0]))
    x = Presence(
        np.repeat(np.arange(len(data)), [len(r[0]) for r in data]), np.array([j for r in data for j in r[0]], np.int64), (len(data), len(chain.vocabulary))
    )
    y = np.array([r[1] for r in data])
    if not earlier:
        more = np.array([j for w, j in chain.vocabulary.items() if chosen[w]], np.int64)
        kind = np.full(len(y), -1)
        kind[y[:, -1] == 1] = kinds(x.part(y[:, -1] == 1).dense()[:, more])
        y = np.column_stack([*(kind == k for k in range(KINDS)), y]).astype(int)
    weight = np.where(y[:, -1] == 1, 1 / share[1], 1 / share[0])
    train(chain, x, y, weight * len(weight) / weight.sum(), np.array([r[2] % FOLDS for r in data]))
    return chain


def judged(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, one probability per category (p_name), toxic.

    A null text counts as empty; texts of any length are read whole; equal
    texts get equal results; repeated rows, null ids and an empty table give as
    many rows; a probability at the threshold is toxic; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            p = shared.value.probabilities(shared.value.matrix(batch.column(1).to_pylist(), cache))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, p.T.copy()), pa.array(shared.value.toxic(p))], ["doc_id", *names, "toxic"])

    schema = ", ".join([f"doc_id {kind}", *[f"`{n}` double" for n in names], "toxic boolean"])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def cleaned(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of ``docs`` that aren't toxic, with all their columns (under any names) and as often as they occur."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            p = shared.value.probabilities(shared.value.matrix(batch.column(at).to_pylist(), cache))
            yield batch.filter(pa.array(~shared.value.toxic(p)))

    return docs.mapInArrow(run, docs.schema)
