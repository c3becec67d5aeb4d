"""Lexical retrieval packing into fixed windows.

Documents are encoded once, and frequencies of terms and lengths are counted
over the whole corpus. Each document is then routed by the terms that weigh
most in it: rows are dealt by ranges of these, so that documents with the same
rare terms lie side by side wherever they were stored, and a term that many
documents have is split by the next ones. Each partition is read as a stream of
blocks, and each block is one shard of a BM25 inverted index over its
documents' tokens. A seed document opens a window; the index returns its unused
neighbours by score, down to the last that shares a term, which greedily fill
the window; the last neighbour is cut where the window ends and its rest stays
in the shard. Shards need no state beyond one block, so a lost task is simply
run again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed
from tidemark.llm.encoding import default_paths, encoder

WINDOW = 2048
END_ID = 1
#: A shard ends with the document that brings it to so many documents or tokens, whichever comes first.
SHARD_DOCS, SHARD_TOKENS = 4096, 3_000_000
#: Terms of the seed that are looked up, and neighbours that are tried, at a time.
QUERY_TERMS, NEIGHBOURS = 24, 64
K1, B = 1.2, 0.75
#: Terms by which a document is routed.
ROUTE = 3

PIECE_SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids in order, and how often each occurs."""
    s = np.sort(ids.astype(np.uint16) if len(ids) and ids.max() < 65536 else ids, kind="stable")
    edge = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.empty(0, np.int64)
    return s[edge], np.diff(np.append(edge, len(s)))


class Corpus:
    """What BM25 needs to know of all documents: their number and mean length, and how many have each term."""

    def __init__(self, count: int, mean: float, df: np.ndarray):
        self.idf = np.log1p((count - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.mean = max(1.0, mean)

    def weights(self, terms: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        tf = tf.astype(np.float32)
        return self.idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / np.float32(self.mean)))

    def route(self, ids: np.ndarray) -> list[int]:
        """The ROUTE heaviest terms (of equal ones the larger id), -1 where there are fewer."""
        terms, tf = _counted(ids)
        weight = self.weights(terms, tf, np.float32(len(ids)))
        if len(terms) > ROUTE:  # all that weigh as much as the last of the heaviest
            near = weight >= np.partition(weight, -ROUTE)[-ROUTE]
            terms, weight = terms[near], weight[near]
        top = terms[np.lexsort((terms, weight))[::-1][:ROUTE]].tolist()
        return top + [-1] * (ROUTE - len(top))


def corpus_of(docs: list[np.ndarray]) -> Corpus:
    terms = np.concatenate([np.zeros(0, np.int64), *[_counted(x)[0] for x in docs]]).astype(np.int64)
    return Corpus(len(docs), sum(map(len, docs)) / max(1, len(docs)), np.bincount(terms))


class Index:
    """BM25 postings of one shard. Terms are token ids; a posting's weight is the whole BM25 factor."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus):
        found = [_counted(x) for x in docs]
        sizes = np.array([len(t) for t, _ in found], np.int64)
        self.end = np.cumsum(sizes)
        self.terms = np.concatenate([t for t, _ in found]).astype(np.int64)
        owner = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        length = np.array([len(x) for x in docs], np.float32)
        self.weight = corpus.weights(self.terms, np.concatenate([n for _, n in found]), length[owner])
        df = np.bincount(self.terms)
        self.weight[df[self.terms] < 2] = 0  # nobody else in the shard has the term
        order = np.argsort(self.terms, kind="stable")
        self.docs, self.posted = owner[order], self.weight[order]
        self.bounds = np.append(0, np.cumsum(df))
        self.count = len(docs)

    def neighbours(self, seed: int, unused: np.ndarray, terms: int, most: int) -> Iterator[np.ndarray]:
        """All unused documents that share a term with the seed, ``most`` at a time, best first; ties by position.

        The heaviest ``terms`` rank first; the next ones are looked up when their documents are used up.
        """
        a, b = (self.end[seed - 1] if seed else 0), self.end[seed]
        weight = self.weight[a:b]
        heavy = np.argsort(-weight, kind="stable")
        heavy = heavy[weight[heavy] > 0]
        fresh = unused.copy()
        for at in range(0, len(heavy), terms):
            spans = [(self.bounds[t], self.bounds[t + 1]) for t in self.terms[a:b][heavy[at : at + terms]].tolist()]
            docs = np.concatenate([self.docs[x:y] for x, y in spans])
            score = np.bincount(docs, np.concatenate([self.posted[x:y] for x, y in spans]), minlength=self.count)
            score *= fresh
            while True:
                best = np.argpartition(-score, most)[:most] if len(score) > most else np.arange(len(score))
                best = best[score[best] > 0]
                if not len(best):
                    break
                yield best[np.lexsort((best, -score[best]))]
                score[best] = 0
                fresh[best] = False


def packed(docs: list[np.ndarray], window: int, terms: int, most: int, corpus: Corpus | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) over one shard.

    Documents of a window or more give whole windows first. Equal documents
    are one entry of the index, and one of them enters a window while others
    fit. Only the last window can end early; it is cut into powers of two.
    """
    total = np.array([len(x) for x in docs], np.int64)
    for d in np.flatnonzero(total >= window).tolist():
        for start in range(0, int(total[d]) - window + 1, window):
            yield [(d, start, window)]
    start = total // window * window
    left = total - start
    numbers: dict[bytes, int] = {}
    content = [numbers.setdefault(x.tobytes(), len(numbers)) for x in docs]
    copies: list[list[int]] = [[] for _ in numbers]
    for d in range(len(docs) - 1, -1, -1):
        if left[d]:
            copies[content[d]].append(d)
    unused = np.array([bool(x) for x in copies])
    index = Index([docs[d] for d in np.unique(content, return_index=True)[1]], corpus or corpus_of(docs))
    order = np.lexsort((np.arange(len(docs)), -left)).tolist()
    spare = 0  # documents of the order before this are used up
    last: list[tuple[int, int, int]] = []

    def take(into: list, d: int, room: int) -> int:
        n = int(min(left[d], room))
        into.append((d, int(start[d]), n))
        start[d] += n
        left[d] -= n
        if not left[d]:
            same = copies[content[d]]
            while same and not left[same[-1]]:
                same.pop()
            unused[content[d]] = bool(same)
        return room - n

    for seed in order:
        if not left[seed]:
            continue
        pieces: list[tuple[int, int, int]] = []
        room = take(pieces, seed, window)
        seen = {content[seed]}
        for near in index.neighbours(content[seed], unused, terms, most) if room else ():
            near = [c for c in near.tolist() if c not in seen]
            for fits in (True, False):
                for c in near:
                    if room and c not in seen and (left[copies[c][-1]] <= room or not fits):
                        room = take(pieces, copies[c][-1], room)
                        seen.add(c)
            if not room:
                break
        while spare < len(order) and not left[order[spare]]:
            spare += 1
        for again in (False, True):
            at = spare
            while room and at < len(order):
                d = order[at]
                if left[d] and (again or content[d] not in seen):
                    room = take(pieces, d, room)
                    seen.add(content[d])
                at += 1
        if room:
            last = pieces
        else:
            yield pieces
    yield from powers(last)


def powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Cut one run of pieces into sequences whose lengths are powers of two, longest first."""
    rest = sum(n for _, _, n in pieces)
    queue = pieces[::-1]
    while rest:
        room = 1 << rest.bit_length() - 1
        rest -= room
        out = []
        while room:
            d, s, n = queue.pop()
            if n > room:
                queue.append((d, s + room, n - room))
                n = room
            out.append((d, s, n))
            room -= n
        yield out


def encoded(docs: DataFrame, key: str, end_id: int, paths: tuple[str, str]) -> DataFrame:
    """``docs`` (key, text) to key, ids (two bytes each, or four if ``wide``), wide; and per task a row without ids
    whose ``terms`` and ``counts`` say in how many of its documents each id occurs."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, df, key_type = encoder(paths), np.zeros(0, np.int64), None
        lists = (pa.list_(pa.int32()), pa.list_(pa.int64()))
        names = ["key", "ids", "wide", "terms", "counts"]
        for batch in batches:
            key_type, blobs, wide, terms = batch.column(0).type, [], [], [np.zeros(0, np.int64)]
            for text in batch.column(1):
                ids = np.append(encode(text.as_py()), np.uint32(end_id))
                wide.append(bool(ids.max() > 65535))
                blobs.append(ids.astype("<u4" if wide[-1] else "<u2").tobytes())
                terms.append(_counted(ids)[0])
            more = np.bincount(np.concatenate(terms).astype(np.int64), minlength=len(df))
            more[: len(df)] += df
            df = more
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary()), pa.array(wide, pa.bool_()), pa.nulls(n, lists[0]), pa.nulls(n, lists[1])], names)
        if key_type is not None:
            at = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, key_type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.bool_()), pa.array([at], lists[0]), pa.array([df[at]], lists[1])], names
            )

    return docs.select(key, "text").mapInArrow(run, f"key {kind}, ids binary, wide boolean, terms array<int>, counts array<long>")


def _ids(blob, wide) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), "<u4" if wide.as_py() else "<u2")


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    window: int = WINDOW,
    end_id: int = END_ID,
    paths=None,
    shard_docs: int = SHARD_DOCS,
    shard_tokens: int = SHARD_TOKENS,
    terms: int = QUERY_TERMS,
    most: int = NEIGHBOURS,
) -> DataFrame:
    """``docs`` (key, text) to pieces: key and PIECE_SCHEMA.

    A document is its ids followed by ``end_id``; a null text counts as empty,
    so every row gives at least one piece. Repeated rows and rows with equal or
    null ids are packed once each. Neighbours that tie are taken in the order
    of routes; a long text ends the shard it is read into, however full that
    is; an empty table gives an empty result; other columns are not read.
    A sequence's number joins the partition's and a running one; its pieces
    fill it from offset 0 without gaps. The sequences depend on how rows are
    dealt to partitions, which a different number of these changes.
    """
    paths = tuple(paths or default_paths())
    kind = docs.schema[key].dataType.simpleString()
    coded = checkpointed(encoded(docs, key, end_id, paths))
    rows = coded.where("ids is not null").select("key", "ids", "wide")
    width = F.octet_length("ids") / F.when(F.col("wide"), 4).otherwise(2)
    count, tokens = rows.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    pair = F.explode(F.arrays_zip("terms", "counts")).alias("p")
    df = coded.where("ids is null").select(pair).groupBy(F.col("p.terms").alias("t")).agg(F.sum("p.counts").alias("n")).toPandas()  # a row per id of the vocabulary
    found = np.zeros(int(df["t"].max()) + 1 if len(df) else 1, np.int64)
    found[df["t"].to_numpy(np.int64)] = df["n"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(Corpus(count, tokens / max(1, count), found))
    route = [f"r{i}" for i in range(ROUTE)]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = np.array([shared.value.route(_ids(*x)) for x in zip(batch.column(1), batch.column(2))], np.int32).reshape(-1, ROUTE)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.ascontiguousarray(c)) for c in tops.T]], [*batch.schema.names, *route])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 36
        names = [key, *[x.split()[0] for x in PIECE_SCHEMA.split(", ")]]

        def flush(keys: list, ids: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows: list[tuple] = []

            def made():
                columns = list(zip(*rows))
                return pa.RecordBatch.from_arrays(
                    [pa.array([keys[d] for d in columns[0]], key_type), *[pa.array(c, pa.int64()) for c in columns[1:]]], names
                )

            for pieces in packed(ids, window, terms, most, shared.value):
                offset = 0
                for d, start, n in pieces:
                    rows.append((d, start, n, zlib.crc32(ids[d][start : start + n]), len(ids[d]), number, offset))
                    offset += n
                number += 1
                if len(rows) >= 8192:
                    yield made()
                    rows.clear()
            if rows:
                yield made()

        keys, ids, held, key_type = [], [], 0, None
        for batch in batches:
            key_type = batch.column(0).type
            for k, blob, wide in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                keys.append(k)
                ids.append(_ids(blob, wide).astype("<u4"))
                held += len(ids[-1])
                if len(keys) >= shard_docs or held >= shard_tokens:
                    yield from flush(keys, ids)
                    keys, ids, held = [], [], 0
        if keys:
            yield from flush(keys, ids)

    schema = f"key {kind}, ids binary, wide boolean, {', '.join(f'{r} int' for r in route)}"
    placed = rows.mapInArrow(routed, schema).withColumn("salt", F.xxhash64("ids"))  # run twice, for the ranges and for the rows: cheaper than another copy
    order = [*route, "salt", "key"]
    dealt = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.select("key", "ids", "wide").mapInArrow(run, f"`{key}` {kind}, {PIECE_SCHEMA}")
