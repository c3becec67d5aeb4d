"""Language identification by interpolated Kneser-Ney character models.

One model per language is estimated from a bounded sample of labelled
documents. Models are merged, up to GROUP languages at a time, into sorted
arrays of n-gram hashes with a row of log probabilities (a column per
language), so that one binary search finds an n-gram for all of them. A text is scored as a whole; the lowest
cross-entropy per character wins. A text whose cross-entropy lies above what
held-back documents of the winning language show is marked as rejected.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, small_or_shuffled

ORDER = 4
#: Bounds of the fit: characters per language in the sample, and n-grams per language and order. Where there are more languages
#: than GROUP, the n-grams that GROUP languages may have are shared among all, so that the models' size is bounded for any number.
SAMPLE_CHARS, MOST_GRAMS, GROUP = 2_000_000, 1 << 16, 32
#: Every so many sampled documents one is held back for calibration.
HOLD_BACK = 5
#: Share of a language's held-back documents that may lie over its rejection limit, and the slack in bits.
REJECT_SHARE, REJECT_SLACK = 0.005, 0.3
UNKNOWN = "und"
EDGE = 1
_P = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 19


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def symbols(texts: list[str], order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters with every run of other characters as one space, order-1 edge symbols before each text.

    Gives the symbols of all texts, where each text begins (with its edges), and its number of letters.
    """
    edge = "\x01" * (order - 1)
    lowered = [x.lower().replace("\x01", " ") for x in texts]
    raw = np.frombuffer("".join([edge + x for x in lowered]).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.cumsum([0, *[len(x) + order - 1 for x in lowered]])
    letter = _letters()[raw]
    sym = np.where(letter | (raw == EDGE), raw, np.uint32(32))
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != 32) | (sym[:-1] != 32)
    at = np.append(0, np.cumsum(keep))
    letters = np.append(0, np.cumsum(letter))
    return sym[keep], at[starts], np.diff(letters[starts])


def rolled(sym: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each place, for n from 1 to ``order``."""
    one = sym.astype(np.uint64) + np.uint64(1)
    out = [one * _P ^ one]
    for _ in range(order - 1):
        before = np.append(np.uint64(0), out[-1][:-1])
        mixed = (before + np.uint64(0x632BE59BD9B4E019)) * _P
        out.append((mixed ^ (mixed >> np.uint64(29))) + one * np.uint64(0xD6E8FEB86659FD93))
    return out


def estimate(texts: list[str], order: int = ORDER, most: int = MOST_GRAMS) -> dict:
    """Interpolated Kneser-Ney tables of one language.

    Per order: n-gram hashes, their contexts' and suffixes' hashes, counts, and
    per context the weight of the lower order. The highest order counts
    occurrences, lower ones the different characters seen before an n-gram. Of
    more than ``most`` n-grams the most frequent are kept (of equal ones those with smaller
    hashes); what the others had goes to their contexts' lower order, so that
    probabilities still sum to one.
    """
    sym, _, _ = symbols(texts, order)
    hashes = rolled(sym, order)
    scored = np.flatnonzero(sym != EDGE)
    scored = scored[scored >= order - 1]
    tables = {}
    grams, at, counts = np.unique(hashes[order - 1][scored], return_index=True, return_counts=True)
    at = scored[at]
    for n in range(order, 0, -1):
        context = hashes[n - 2][at - 1] if n > 1 else np.zeros(len(at), np.uint64)
        suffix = hashes[n - 2][at] if n > 1 else np.zeros(len(at), np.uint64)
        ones, twos = int((counts == 1).sum()), int((counts == 2).sum())
        discount = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
        keys, inverse = np.unique(context, return_inverse=True)
        total = np.bincount(inverse, counts)
        weight = discount * np.bincount(inverse) / total if len(keys) else total
        main = (counts - discount) / total[inverse] if len(keys) else counts.astype(float)
        if len(grams) > most:
            top = np.sort(np.argsort(-counts, kind="stable")[:most])
            gone = np.ones(len(grams), bool)
            gone[top] = False
            weight = weight + np.bincount(inverse[gone], main[gone], len(keys))
            tables[n] = (grams[top], context[top], suffix[top], main[top], keys, weight)
        else:
            tables[n] = (grams, context, suffix, main, keys, weight)
        if n > 1:
            lower, first, inverse = np.unique(suffix, return_index=True, return_inverse=True)
            counts = np.bincount(inverse)  # each n-gram is one way to go on to the left
            grams, at = lower, at[first]
    return tables


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Tables:
    """Some languages' models in common sorted arrays: per order n-grams with log probabilities, contexts with log weights.

    ``size``: the characters there may be; those not seen share the rest.
    """

    def __init__(self, tables: dict[str, dict], size: int, order: int = ORDER):
        self.langs, self.order = sorted(tables), order
        count = len(self.langs)
        self.grams, self.logp, self.contexts, self.logw = [], [], [], []
        lower = None
        for n in range(1, order + 1 if count else 1):
            parts = [tables[x][n] for x in self.langs]
            grams, first = np.unique(np.concatenate([p[0] for p in parts]), return_index=True)
            context, suffix = np.concatenate([p[1] for p in parts])[first], np.concatenate([p[2] for p in parts])[first]
            contexts = np.unique(np.concatenate([p[4] for p in parts]))
            weights = np.ones((len(contexts), count))
            for j, p in enumerate(parts):
                weights[np.searchsorted(contexts, p[4]), j] = p[5]
            if n == 1:
                self.rest = np.log(weights[0] / size) if len(contexts) else np.full(count, -np.log(size))
                below = np.full((len(grams), count), 1.0 / size)
            else:
                at, found = _find(self.grams[-1], suffix)
                below = np.where(found[:, None], lower[at], np.exp(self.rest))
            at, found = _find(contexts, context)
            prob = np.where(found[:, None], weights[at], 1.0) * below
            for j, p in enumerate(parts):
                prob[np.searchsorted(grams, p[0]), j] += p[3]
            lower = prob
            self.grams.append(grams)
            self.logp.append(np.log(prob).astype(np.float32))
            self.contexts.append(contexts)
            self.logw.append(np.log(weights).astype(np.float32))

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sym, starts, letters = symbols(texts, self.order)
        hashes = rolled(sym, self.order)
        total = np.zeros((len(texts), len(self.langs)))
        owner = np.repeat(np.arange(len(texts)), np.diff(starts))
        todo = np.flatnonzero(sym != EDGE)
        count = np.bincount(owner[todo], minlength=len(texts))

        def add(places: np.ndarray, table: np.ndarray, rows: np.ndarray) -> None:
            if len(places):
                who = owner[places]
                edge = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
                for j in range(table.shape[1]):
                    total[who[edge], j] += np.add.reduceat(table[:, j][rows], edge, dtype=np.float64)

        for n in range(self.order, 0, -1):
            at, found = _find(self.grams[n - 1], hashes[n - 1][todo])
            add(todo[found], self.logp[n - 1], at[found])
            todo = todo[~found]
            if n > 1 and len(todo):
                at, found = _find(self.contexts[n - 1], hashes[n - 2][todo - 1])
                add(todo[found], self.logw[n - 1], at[found])
        np.add.at(total, owner[todo], self.rest)
        return -total / np.log(2) / np.maximum(count, 1)[:, None], letters


class Models:
    """All languages' models, in groups, and what turns their cross-entropies into a verdict."""

    def __init__(self, tables: dict[str, dict], order: int = ORDER, group: int = GROUP):
        self.langs = sorted(tables)
        size = max([2, *[len(t[1][0]) for t in tables.values()]]) * 2
        self.groups = [Tables({x: tables[x] for x in self.langs[at : at + group]}, size, order) for at in range(0, len(self.langs), group)]
        self.temperature, self.limits = 8.0, np.full(len(self.langs), np.inf)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character under each language, and the number of letters, of every whole text."""
        bits, letters = [np.zeros((0, len(self.langs)))], [np.zeros(0, np.int64)]
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= _CHUNK):
                held += len(texts[end])
                end += 1
            found = [g.entropies(texts[at:end]) for g in self.groups]
            bits.append(np.concatenate([b for b, _ in found], axis=1))
            letters.append(found[0][1])
            at = end
        return np.concatenate(bits), np.concatenate(letters)

    def calibrate(self, bits: np.ndarray, truth: np.ndarray) -> None:
        """Fit the temperature (least log loss of the labels) and each language's rejection limit."""
        if not len(truth):
            return
        def loss(t):
            z = -t * (bits - bits.min(axis=1, keepdims=True))
            p = np.exp(z[np.arange(len(z)), truth]) / np.exp(z).sum(axis=1)
            return -np.log(0.999 * p + 0.001 / bits.shape[1]).mean()

        self.temperature = min(np.geomspace(0.5, 64, 29), key=loss)
        for j in range(len(self.langs)):
            own = bits[truth == j, j]
            if len(own):
                self.limits[j] = np.quantile(own, 1 - REJECT_SHARE) + REJECT_SLACK

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, bits per character and whether it is rejected. Without letters or models: ``und`` and 0."""
        if not self.langs:
            none = np.zeros(len(texts))
            return [UNKNOWN] * len(texts), none, none, none > 0
        bits, letters = self.entropies([x or "" for x in texts])
        best = bits.argmin(axis=1) if len(bits) else np.zeros(0, np.int64)
        low = bits[np.arange(len(bits)), best]
        score = 1 / np.exp(-self.temperature * (bits - low[:, None])).sum(axis=1)
        known = letters > 0
        langs = [self.langs[j] if k else UNKNOWN for j, k in zip(best.tolist(), known.tolist())]
        return langs, np.where(known, score, 0.0), np.where(known, low, 0.0), known & (low > self.limits[best])


def held_out(doc_id: Column) -> Column:
    """Documents never learned from: crc32 of the id as text is 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_chars: int = SAMPLE_CHARS, order: int = ORDER) -> Models:
    """Models from ``docs`` (doc_id, text, lang), of those with an id, a text and a language that aren't held out.

    Per language documents are drawn by a hash of id and text, the smallest
    first, until about ``sample_chars`` characters are there (at most twice
    that, unless one text has more); texts are used whole. Every language has at
    least one document that is learned from, and only others are held back for
    calibration. The driver sees a row per language.
    """
    known = docs.where("doc_id is not null and text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    known = known.select("doc_id", "text", "lang").withColumn("_draw", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)))
    per_lang = known.groupBy("lang").agg(F.sum(F.length("text").cast("long")).alias("chars"), F.min("_draw").alias("_first"), F.max(F.octet_length("lang")).alias("_name"))
    shares = checkpointed(per_lang.withColumn("_most", F.least(F.lit(1.0), F.lit(float(sample_chars)) / F.greatest("chars", F.lit(1))) * (1 << 30)))
    langs, name = shares.agg(F.count("*"), F.coalesce(F.max("_name"), F.lit(0))).first()
    if not langs:
        return Models({}, order)
    most = MOST_GRAMS if langs <= GROUP else max(1, MOST_GRAMS * GROUP // langs)
    shares = small_or_shuffled(shares.select(F.col("lang").alias("_lang"), "_first", "_most"), langs, name + 32)
    drawn = known.join(shares, F.col("lang") == F.col("_lang")).where((F.col("_draw") < F.col("_most")) | (F.col("_draw") == F.col("_first")))
    sample = checkpointed(drawn.select("text", "lang", "_draw", "_first"))
    back = (F.pmod(F.xxhash64("_draw"), F.lit(HOLD_BACK)) == 0) & (F.col("_draw") > F.col("_first"))

    def learn(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        texts, held = [], 0
        for text in group.sort_values(["_draw", "text"])["text"]:
            if not texts or held + len(text) <= 2 * sample_chars:
                texts.append(text)
                held += len(text)
        return pd.DataFrame({"lang": [key[0]], "tables": [pickle.dumps(estimate(texts, order, most))]})

    learned = sample.where(~back).groupBy("lang").applyInPandas(learn, "lang string, tables binary").collect()
    models = Models({r[0]: pickle.loads(r[1]) for r in learned}, order)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def score(batches):
        for batch in batches:
            bits, letters = shared.value.entropies(batch.column(1).to_pylist())
            keep = letters > 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), pa.array(list(bits[keep]), pa.list_(pa.float64()))], ["lang", "bits"]
            )

    if models.langs:
        rows = sample.where(back).select("lang", "text").mapInArrow(score, "lang string, bits array<double>").collect()
        place = {x: j for j, x in enumerate(models.langs)}
        rows = [r for r in rows if r[0] in place]
        models.calibrate(np.array([r[1] for r in rows]).reshape(len(rows), len(place)), np.array([place[r[0]] for r in rows], np.int64))
    return models


def predicted(docs: DataFrame, models: Models, reject: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, lang_pred, score, bits, rejected; only the text is looked at.

    With ``reject`` a rejected text's language is ``und``. Null texts and texts
    without letters are ``und`` with score 0, and so is every text if no
    language was learned. Languages that tie are taken by name. Texts of any
    length are read whole; equal texts get equal results; repeated rows, null
    ids and an empty table give as many rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, bits, rejected = shared.value.predict(batch.column(1).to_pylist())
            if reject:
                langs = [UNKNOWN if r else x for x, r in zip(langs, rejected.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(bits), pa.array(rejected)],
                ["doc_id", "lang_pred", "score", "bits", "rejected"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, bits double, rejected boolean")
