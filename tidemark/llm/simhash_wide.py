"""SimHash near-duplicate removal by similarity: shared rare shingles, wide fingerprints, and verified links.

A Jaccard similarity of 0.8 over word shingles lets 15 % of SimHash's bits
differ. At that radius pivot tables of distances between fingerprints discard nothing (unrelated fingerprints'
coordinates differ by far less than it), and no keys of fingerprint bits are
equal for certain. Keys of the shingles themselves are: if every set is put in
one common order, two sets that are similar enough share a shingle among the
first ones of both (a fifth of each, at 0.8), at places from which the rest can
still make up the overlap. The order is rarest first, so that passages that
many documents share come last and bring few together. It rests on counts over
all documents; any order gives the same links. A fixed part of all hashes (DRAWN) comes first, by exact
counts, so that a document sends three eighths of its shingles to be counted and
knows nearly always a fifth that come before all others. What comes back are the shingles that another document has
too; where those that nobody else has fill the first fifth, nothing is left to compare.

Of the pairs that meet so, fingerprints discard those that lie beyond six
standard deviations of what 0.8 gives, and pivot tables of sets, which hold how
many shingles lie in each of 64 reference sets, and up to two of them in each of 256, those whose coordinates differ
by more than such a pair's shingles can (for certain). The survivors are decided
by their whole shingle sets. No link is made without that. Verification runs in three
rounds: for a spanning forest of likely links among the documents that have
their smallest or largest shared key in common, for one over the components
that each key has then, of all that may be similar and the nearest first, and last for all pairs that are in different
components still. So a group of near copies costs a few links for each, not all pairs, also where most are barely similar enough. Large groups are cut into cells, each pair of cells being
a task's group of its own. Per document the shuffles carry 8 bytes for three eighths of its shingles, whatever the number
of documents, and a key and the three before it for each leading one that is shared; by these a pair is named once, not at every key it shares.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, shielded, small_or_shuffled
from tidemark.llm.simhash import SEED, _roots, _unite, components

SHINGLE, SIMILARITY = 5, 0.8
WORDS = 6
BITS = 64 * WORDS
#: Standard deviations of differing bits beyond which a pair is discarded; sets with fewer shingles are never discarded by bits.
DEVIATIONS, SHORT = 6, 32
#: Shingles are counted by so many parts of their hash first, sent in so many pieces. Those that may be in so many documents, and
#: in more than all but one in so many parts hold, are then counted one by one.
PARTS, PIECES, COMMON, FULLEST = 1 << 22, 256, 4, 64
#: Hashes below this are ordered by their counts, before all others. Of a hash with its document's place in a block of ids 47 bits
#: are kept, and one that says whether it is one of those.
DRAWN = np.uint64(3 << 61)
_PLACE, _KEY, _OTHER = np.uint64((1 << 16) - 1), ~np.uint64((1 << 17) - 1), np.uint64(1 << 16)
#: Shingles counted by a task at most (of one block of ids at least), and those of a block of ids.
SLICE, BLOCK = 1 << 22, 1 << 20
#: Rows of a key that are compared in one group; pairs held at a time; groups over which a document's partners are dealt.
CELL, _HELD, _DEAL = 2048, 1 << 20, 256
#: A row carries so many of the keys before its own: a pair that shares one of them has met there already.
PREVIOUS = 3
_CHUNK = 1 << 15
#: Reference sets (by the shingles' hashes) with which each set's overlap is counted, up to 255, in eight counts a word.
PIVOTS = 64
#: Smaller reference sets, with which overlaps are counted up to two, in two bits each: they tell short sets apart.
FINE = 256
_NAMES = [*(f"w{i}" for i in range(WORDS)), *(f"c{i}" for i in range(PIVOTS // 8)), *(f"f{i}" for i in range(FINE // 32))]
_SALTS = np.array([xxhash.xxh64_intdigest(f"word {i}".encode(), seed=SEED) for i in range(WORDS)], np.uint64)


def flip_rate(similarity: float) -> float:
    """Share of differing bits at a Jaccard similarity of two sets of one size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def limits(similarity: float) -> tuple[int, int]:
    """Differing bits up to which a pair is likely to be that similar, and up to which it may be at all."""
    p = flip_rate(similarity)
    deviation = math.sqrt(BITS * p * (1 - p))
    return int(BITS * p - 2 * deviation), math.ceil(BITS * p + DEVIATIONS * deviation)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles of a whole text in lower case (A-Z), in no order; a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = set(map(b" ".join, zip(*(words[i:] for i in range(shingle))))) if len(words) >= shingle else {b" ".join(words)}
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(grams))


def fingerprint(grams: np.ndarray) -> np.ndarray:
    """WORDS words of SimHash over a set of shingles; zero for the empty set."""
    if not len(grams):
        return np.zeros(WORDS, np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(grams), _CHUNK):
        x = (grams[at : at + _CHUNK, None] ^ _SALTS) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")


def coordinates(grams: np.ndarray) -> np.ndarray:
    """How many of the shingles lie in each of PIVOTS disjoint reference sets (at most 255), as words.

    Two sets differ in at least as many shingles as their coordinates differ by in all.
    """
    return np.minimum(np.bincount((grams % np.uint64(PIVOTS)).astype(np.int64), minlength=PIVOTS), 255).astype(np.uint8).view("<u8")


def fine_coordinates(grams: np.ndarray) -> np.ndarray:
    """Whether at least one and two of the shingles lie in each of FINE disjoint reference sets, as words: two sets differ in as many shingles as bits at least."""
    counts = np.bincount((grams // np.uint64(PIVOTS) % np.uint64(FINE)).astype(np.int64), minlength=FINE)
    return np.packbits(np.concatenate([counts > 0, counts > 1]), bitorder="little").view("<u8")


def prefix(sizes, similarity: float = SIMILARITY):
    """How many leading shingles sets of these sizes have: any set as similar as that has one of them among its own."""
    sizes = np.asarray(sizes, np.int64)
    return np.where(sizes > 0, sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1, 0)


def _common(grams: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The counts of the common shingles among these, 0 for others."""
    names, counts = common
    if not len(names) or not len(grams):
        return np.zeros(len(grams), np.int64)
    at = np.minimum(np.searchsorted(names, grams), len(names) - 1)
    return np.where(names[at] == grams, counts[at], 0)


def leading(grams: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float = SIMILARITY, count: int | None = None) -> np.ndarray:
    """The first shingles of a set in a common order (how common, then hash), a prefix of it unless their number is given."""
    count = int(prefix(len(grams), similarity)) if count is None else count
    return grams[np.lexsort((grams, _common(grams, common)))[:count]]


def sent(grams: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float = SIMILARITY) -> tuple[np.ndarray, int]:
    """What a set sends to be counted, and how many of these are drawn: all its shingles under DRAWN that are not common, and
    the leading ones of the others where those are fewer than its prefix."""
    drawn = grams[grams < DRAWN]
    drawn = drawn[_common(drawn, common) == 0]
    lack = int(prefix(len(grams), similarity)) - len(drawn)
    if lack <= 0:
        return drawn & _KEY, len(drawn)
    others = leading(np.setdiff1d(grams, drawn, assume_unique=True), common, count=lack)
    return np.concatenate([drawn & _KEY, others & _KEY | _OTHER]), len(drawn)


def common_shingles(docs: DataFrame, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most common shingles of all ``docs`` (text), and in how many documents each is.

    A first pass counts all shingles by PARTS of their hash. A shingle is in no
    more documents than its part's count says, so that a second pass over all
    documents, which counts those of the fullest parts one by one, has every
    shingle with as many documents as such a part needs.
    """

    def sets(batch: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(shingles(x.as_py(), shingle) for x in batch.column(0))])

    def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(PARTS, np.int64)
        for batch in batches:
            counts += np.bincount((sets(batch) % np.uint64(PARTS)).astype(np.int64), minlength=PARTS)
        if counts.any():
            yield packed(dict(enumerate(np.split(counts, PIECES))))

    def packed(pieces: dict[int, np.ndarray]) -> pa.RecordBatch:
        counts = [zlib.compress(x.tobytes(), 1) for x in pieces.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int32()), pa.array(counts, pa.binary())], ["piece", "counts"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                pieces[piece] = pieces.get(piece, 0) + np.frombuffer(zlib.decompress(counts.as_py()), np.int64)
        if pieces:
            yield packed(pieces)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.unpackbits(shared.value)
        for batch in batches:
            grams = sets(batch)
            names, n = np.unique(grams[full[(grams % np.uint64(PARTS)).astype(np.int64)] > 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], ["s", "n"])

    schema = "piece int, counts binary"
    counts = np.zeros(PARTS, np.int64).reshape(PIECES, -1)
    for row in docs.select("text").mapInArrow(by_part, schema).repartition("piece").mapInArrow(summed, schema).toLocalIterator():
        counts[row.piece] = np.frombuffer(zlib.decompress(row.counts), np.int64)
    counts = counts.ravel()
    least = max(COMMON, int(np.partition(counts, -(PARTS // FULLEST))[-(PARTS // FULLEST)]) + 1)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(counts >= least))
    counted = docs.select("text").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    rows = counted.toPandas()
    names, counts = rows["s"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(names)
    return names[order], counts[order]


def wide_prints(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` (doc_id, h1, h2, text) to those without the text, and id (of the row), n (shingles), keys (sent), how many are drawn, fingerprint.

    Ids number the rows of a task in blocks of 65,536; a block also ends with BLOCK keys.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 36, 0
        for batch in batches:
            ids, sizes, drawn, keys, prints = [], [], [], [], np.zeros((batch.num_rows, len(_NAMES)), np.uint64)
            for i, text in enumerate(batch.column(3)):
                grams = shingles(text.as_py(), shingle)
                own, count = sent(grams, shared.value, similarity)
                held = held + len(own) if number & 0xFFFF else len(own)
                if held > BLOCK and number & 0xFFFF:
                    number, held = (number | 0xFFFF) + 1, len(own)
                ids.append(number)
                number += 1
                sizes.append(len(grams))
                drawn.append(count)
                keys.append(own.tobytes())
                prints[i] = np.concatenate([fingerprint(grams), coordinates(grams), fine_coordinates(grams)])
            columns = [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in prints.T]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(drawn, pa.int32()), pa.array(keys, pa.binary()), *columns],
                ["doc_id", "h1", "h2", "id", "n", "drawn", "keys", *_NAMES],
            )

    schema = f"doc_id {kind}, h1 long, h2 long, id long, n int, drawn int, keys binary, {', '.join(f'{n} long' for n in _NAMES)}"
    return docs.select("doc_id", "h1", "h2", "text").mapInArrow(run, schema)


def met_keys(reps: DataFrame, similarity: float = SIMILARITY, most: int = SLICE) -> DataFrame:
    """Rows of distinct texts (id, n, drawn, keys) to one for each leading shingle that another sent too: key, id, n, pos, those before it.

    Keys are counted by slices of their hash. What more than one document sent goes
    back to the blocks of ids it came from, where each document's order is then
    known: drawn ones that nobody else has, those that others have by their counts, the others.
    """
    before = [f"p{i}" for i in range(PREVIOUS)]
    total = reps.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    slices = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (8 * most)))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(1)]
            ids, flat = batch.column(0).to_numpy(), np.concatenate([np.zeros(0, np.uint64), *keys])
            ids = np.repeat(ids, [len(x) for x in keys])
            part = (flat >> np.uint64(17)) % np.uint64(slices)
            for block in np.unique(ids >> 16).tolist():
                own = np.flatnonzero(ids >> 16 == block)
                own = own[np.argsort(part[own], kind="stable")]
                entries, p = flat[own] | ids[own].view(np.uint64) & _PLACE, part[own]
                ends = np.append(np.flatnonzero(p[1:] != p[:-1]) + 1, len(p)).tolist()
                blobs = [entries[a:b].tobytes() for a, b in zip([0, *ends], ends)]
                where = pa.array(p[np.array(ends) - 1].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(ends), pa.int64()), where, pa.array(blobs, pa.binary())], ["block", "slice", "e"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, blobs = [], []
        for batch in batches:
            blocks += batch.column(0).to_pylist()
            blobs += [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(2)]
        if not blobs:
            return
        entries, owner = np.concatenate(blobs), np.repeat(np.array(blocks, np.int64), [len(x) for x in blobs])
        order = np.argsort(entries & ~_PLACE, kind="stable")
        key = entries[order] & ~_PLACE
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count = np.diff(np.append(edge, len(key)))
        count = np.repeat(count, count)
        order, count = order[count > 1], count[count > 1]
        entries, owner = entries[order], owner[order]
        order = np.argsort(owner, kind="stable")
        entries, owner, count = entries[order], owner[order], np.minimum(count[order], 2**31 - 1).astype(np.int32)
        for at in range(0, len(owner), 1 << 18):
            e, o, c = entries[at : at + (1 << 18)], owner[at : at + (1 << 18)], count[at : at + (1 << 18)]
            ends = np.append(np.flatnonzero(o[1:] != o[:-1]) + 1, len(o)).tolist()
            spans = list(zip([0, *ends], ends))
            columns = [pa.array(o[np.array(ends) - 1]), *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (e, c))]
            yield pa.RecordBatch.from_arrays(columns, ["block", "e", "c"])

    def ordered(places: np.ndarray, n: np.ndarray, drawn: np.ndarray, ids: np.ndarray, entries: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        row = np.zeros(1 << 16, np.int64)
        row[places] = np.arange(len(places))
        row = row[(entries & _PLACE).astype(np.int64)]
        key, other = (entries & ~_PLACE).view(np.int64), entries & _OTHER > 0
        order = np.lexsort((key, count, other, row))
        row, key, other = row[order], key[order], other[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        known = np.bincount(row[~other], minlength=len(ids))  # drawn ones that others have
        pos = np.where(other, drawn[row], drawn[row] - known[row] + rank)  # at least
        keep = pos < prefix(n, similarity)[row]
        row, key, rank, pos = row[keep], key[keep], rank[keep], pos[keep]
        last = [pa.array(np.where(rank > i, np.roll(key, i + 1), ids[row] << 1 | 1)) for i in range(PREVIOUS)]  # no key is odd
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[row]), pa.array(n[row].astype(np.int32)), pa.array(pos.astype(np.int32)), *last], ["key", "id", "n", "pos", *before])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, docs, found = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if found:
                ids, n, drawn = np.concatenate(docs, axis=1)
                whole = ordered(ids & 0xFFFF, n, drawn, ids, *(np.concatenate(x) for x in zip(*found)))
                for at in range(0, whole.num_rows, 1 << 17):
                    yield whole.slice(at, 1 << 17)

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if blocks[a] != block:
                    yield from done()
                    block, docs, found = blocks[a], [], []
                part = batch.slice(a, b - a)
                of_docs = part.filter(part.column(1).is_valid())
                docs.append(np.stack([of_docs.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3)]))
                of_keys = part.filter(part.column(4).is_valid())
                found += [(np.frombuffer(e.as_py(), np.uint64), np.frombuffer(c.as_py(), np.int32)) for e, c in zip(of_keys.column(4), of_keys.column(5))]
        yield from done()

    blobs = reps.select("id", "keys").mapInArrow(spread, "block long, slice int, e binary").repartitionById(slices, F.col("slice"))
    shared = blobs.mapInArrow(counted, "block long, e binary, c binary")
    none = F.lit(None)
    of_docs = reps.select(F.shiftright("id", 16).alias("block"), "id", "n", "drawn", none.cast("binary").alias("e"), none.cast("binary").alias("c"))
    of_keys = shared.select("block", none.cast("long").alias("id"), none.cast("int").alias("n"), none.cast("int").alias("drawn"), "e", "c")
    by_block = of_docs.union(of_keys).repartition("block").sortWithinPartitions("block", F.col("id").isNull())
    return by_block.mapInArrow(placed, f"key long, id long, n int, pos int, {', '.join(f'{b} long' for b in before)}")


def meeting(reps: DataFrame, cell: int = CELL, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of distinct texts (id, n, drawn, keys, words) to one for each leading shingle that another has too: key, cells, id, n, pos, the keys before it, words."""
    before = [f"p{i}" for i in range(PREVIOUS)]
    keyed = checkpointed(met_keys(reps, similarity))
    sizes = checkpointed(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    cells = sizes.select("key", F.ceil(F.col("size") / cell).cast("long").alias("cells"))
    met = keyed.join(small_or_shuffled(cells, sizes.count(), 16), "key")
    return checkpointed(met.join(reps.select("id", *_NAMES), "id").select("key", "cells", "id", "n", "pos", *before, *_NAMES))


def _spanning(parent: np.ndarray, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Which of the edges make a spanning forest over the components of ``parent``, the nearest ones first."""
    parent, left, taken = parent.copy(), np.lexsort((j, i, far)), np.zeros(len(i), bool)
    while len(left):
        a, b = _roots(parent, i[left]), _roots(parent, j[left])
        apart = a != b
        left, ends = left[apart], np.stack([a[apart], b[apart]], axis=1).ravel()
        nearest = left[np.unique(np.unique(ends, return_index=True)[1] // 2)]
        taken[nearest] = True
        _unite(parent, i[nearest], j[nearest])
    return np.flatnonzero(taken)


def candidates(
    met: DataFrame, similarity: float = SIMILARITY, roots: DataFrame | None = None, forest: bool = True, previous: int = PREVIOUS, nearest: bool = False
) -> DataFrame:
    """Pairs (u, v) of rows of ``met`` with a common key, in different components by ``roots`` (node, root; without it each is its own).

    With ``forest`` those of a spanning forest of the likely ones over each
    group's components, at most one less than these; with ``nearest`` those of a forest
    of all that may be similar, at most as many, by how far apart they seem; else all that may be similar,
    each where it meets first and not again at keys whose ``previous`` ones it shares
    (what is tested there is at least as lenient, so that none is lost).
    """
    likely, most = limits(similarity)
    forest = forest and not nearest
    previous = 0 if forest or nearest else previous
    fixed, words = 8 + previous, _NAMES[:WORDS] if forest else _NAMES
    met = met.withColumn("root", F.col("id")) if roots is None else met.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    part = F.pmod(F.xxhash64("id"), F.col("cells"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
    rows = met.withColumn("part", part).withColumn("other", other).withColumn("a", F.least("part", "other")).withColumn("b", F.greatest("part", "other"))

    def pairs(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def compared(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole groups, sorted; in those of two cells only pairs of different parts are compared."""
        n = len(keys)
        coarse, fine = slice(WORDS, WORDS + PIVOTS // 8), slice(WORDS + PIVOTS // 8, None)
        table = None if forest else np.ascontiguousarray(prints[:, coarse]).astype("<u8").view(np.uint8).reshape(n, PIVOTS)
        group = np.cumsum(np.append(0, (keys[1:, :3] != keys[:-1, :3]).any(axis=1)))
        across, part, ids, size, pos, own = keys[:, 1] != keys[:, 2], keys[:, 3], keys[:, 4], keys[:, 5], keys[:, 6], keys[:, 7]
        ends = np.append(np.flatnonzero(group[1:] != group[:-1]), n - 1)
        follow = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
        _, first, inverse = np.unique(np.stack([group, own], axis=1), axis=0, return_index=True, return_inverse=True)
        parent = first[inverse.ravel()]  # rows of one component are united from the start
        root, active = parent.copy(), np.arange(n)
        found, held = [], 0

        def thinned(found: list[np.ndarray]) -> list[np.ndarray]:
            edges = np.concatenate(found, axis=1)
            i, j = edges[:2].astype(np.int64)
            return [edges[:, _spanning(parent, i, j, edges[2])]]

        for step in range(1, int(follow.max(initial=0)) + 1):
            active = active[follow[active] >= step]
            i = active[(root[active] != root[active + step]) & (~across[active] | (part[active] != part[active + step]))]
            j = i + step
            overlap = np.minimum(size[i] - pos[i], size[j] - pos[j])  # at most, if this is the first key they share
            fits = overlap * (1 + similarity) >= similarity * (size[i] + size[j]) - 1e-6
            i, j = i[fits], j[fits]
            bits = np.bitwise_count(prints[i, :WORDS] ^ prints[j, :WORDS]).sum(axis=1, dtype=np.int64)
            if forest:
                near = bits <= likely
                if not near.any():
                    continue
                i, j = i[near], j[near]
                _, once = np.unique(np.sort(np.stack([root[i], root[j]], axis=1), axis=1), axis=0, return_index=True)
                i, j = i[once], j[once]
                _unite(parent, i, j)
                root = _roots(parent, np.arange(n))
            else:
                near = (bits <= most) | (np.minimum(size[i], size[j]) < SHORT)
                i, j, bits = i[near], j[near], bits[near]
                apart = np.bitwise_count(prints[i, fine] ^ prints[j, fine]).sum(axis=1, dtype=np.int64)
                near = apart * (1 + similarity) <= (1 - similarity) * (size[i] + size[j]) + 1e-6
                far = bits[near] / most + apart[near] / (size[i[near]] + size[j[near]])
                i, j = i[near], j[near]
                apart = np.abs(table[i].astype(np.int16) - table[j]).sum(axis=1, dtype=np.int64)
                near = apart * (1 + similarity) <= (1 - similarity) * (size[i] + size[j]) + 1e-6
                i, j, far = i[near], j[near], far[near]
                if nearest:
                    held += len(i)
                    found.append(np.stack([i, j, far]))
                    if held > _HELD // 4:
                        found, held = thinned(found), 0
                    continue
                known = np.zeros(len(i), bool)
                for x in range(previous):
                    for y in range(previous):
                        known |= keys[i, 8 + x] == keys[j, 8 + y]
                i, j = i[~known], j[~known]
            found.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]))
            held += len(i)
            if held > _HELD:
                yield pairs(*np.concatenate(found, axis=1))
                found, held = [], 0
        if nearest and found:
            i, j = thinned(found)[0][:2].astype(np.int64)
            found = [np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])])]
        if found:
            yield pairs(*np.concatenate(found, axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.zeros((0, fixed), np.int64), np.zeros((0, len(words)), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, np.stack([batch.column(c).to_numpy() for c in range(fixed)], axis=1)])
            prints = np.concatenate([prints, np.stack([batch.column(fixed + i).to_numpy() for i in range(len(words))], axis=1).view(np.uint64)])
            change = np.flatnonzero((keys[1:, :3] != keys[:-1, :3]).any(axis=1))  # the last group may go on in the next batch
            if len(change):
                whole = int(change[-1]) + 1
                yield from compared(keys[:whole], prints[:whole])
                keys, prints = keys[whole:], prints[whole:]
        if len(keys):
            yield from compared(keys, prints)

    groups = rows.select("key", "a", "b", "part", "id", F.col("n").cast("long"), F.col("pos").cast("long"), "root", *[f"p{i}" for i in range(previous)], *words)
    dealt = groups.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "part", "id")
    return dealt.mapInArrow(run, "u long, v long").select("u", "v").distinct()


def similar_pairs(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The (u, v) of ``pairs`` whose ``texts`` (id, text) have that Jaccard similarity over distinct shingles.

    A text's shingles are hashed once. A pair carries the set of v; that of u
    is sent once to each of the groups over which its partners are dealt.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.sort(shingles(x.as_py(), shingle)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "s"])

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whose, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for u, v, s in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = np.frombuffer(s, np.uint64)
                if v is None:
                    whose, own = u, s
                    keep.append(False)
                    continue
                if whose != u:
                    raise ValueError("a pair came before its first text")
                both = len(np.intersect1d(own, s, assume_unique=True))
                keep.append(both * (1 + similarity) >= similarity * (len(own) + len(s)) - 1e-6)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    sets = checkpointed(texts.select("id", "text").mapInArrow(hashed, "id long, s binary"))
    dealt = pairs.withColumn("deal", F.pmod(F.xxhash64("v"), F.lit(_DEAL)))
    heads = dealt.select("u", "deal").distinct().join(sets.toDF("u", "s"), "u").select("u", F.lit(None).cast("long").alias("v"), "s", "deal")
    tails = dealt.join(sets.toDF("v", "s"), "v").select("u", "v", "s", "deal")
    rows = heads.union(tails).repartition("u", "deal").sortWithinPartitions("u", "deal", F.col("v").asc_nulls_first())
    return rows.select("u", "v", "s").mapInArrow(tested, "u long, v long")


def _hashed(text: Column) -> dict[str, Column]:
    """Two hashes that tell texts apart; all texts without words are one."""
    held = F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise(F.lit(""))
    return {"h1": F.xxhash64(held), "h2": F.xxhash64(F.lit("second"), held)}


def linked_classes(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """``docs`` (doc_id, h1, h2, text) to prints (doc_id, h1, h2, ...) and classes: h1, h2, best (none, doc_id, id), root, one row per text."""
    prints = checkpointed(wide_prints(docs, common_shingles(docs, shingle), similarity, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id"))
    texts = checkpointed(prints.groupBy("h1", "h2").agg(first.alias("best"), F.count("*").alias("rows")))
    several = texts.where("rows > 1").select("h1", "h2", F.col("best.id").alias("stays"))
    copies = checkpointed(prints.select("h1", "h2", "id").join(small_or_shuffled(several, several.count(), 32), ["h1", "h2"]).where("id <> stays").select("id"))
    reps = prints.join(small_or_shuffled(copies, copies.count(), 16), "id", "left_anti")
    met = meeting(reps, cell, similarity)

    def verified(pairs: DataFrame) -> DataFrame | None:
        pairs = checkpointed(pairs)
        if not pairs.head(1):
            return None
        wanted = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
        wanted = checkpointed(texts.select("h1", "h2", "best.doc_id", "best.id").join(wanted, "id").toDF("id", "h1_", "h2_", "id_"))
        same = (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_")) & F.col("doc_id").eqNullSafe(F.col("id_"))
        return similar_pairs(pairs, docs.join(small_or_shuffled(wanted, wanted.count(), 48), same).select("id", "text"), similarity, shingle)

    ends = met.groupBy("id").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    few = met.join(ends, "id").where("key = low or key = high").drop("low", "high")
    roots = None
    for rows, how in ((few, {}), (met, {"nearest": True}), (met, {"forest": False})):
        found = verified(candidates(rows, similarity, roots, **how))
        if found is not None:
            roots = checkpointed(components(found if roots is None else roots.toDF("u", "v").union(found)))
    if roots is None:
        roots = docs.sparkSession.createDataFrame([], "node long, root long")
    classes = texts.withColumn("id", F.col("best.id")).join(roots, F.col("id") == F.col("node"), "left")
    return prints, checkpointed(classes.select("h1", "h2", "best", F.coalesce("root", "id").alias("root")))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of texts linked by similarity the one with the smallest doc_id.

    Similarity is Jaccard's over the distinct shingles of lower-cased words; a
    text shorter than a shingle is one shingle. Exact copies always fall
    together, and so do all pairs of ``similarity`` or more, in dense regions
    as elsewhere; no others. Null ids come last; texts without words (null,
    empty or white space) are one group; rows equal in id and text count as one
    document, and one of them stays (which is not defined where their other
    columns differ). Of different texts with one smallest id one stays. Texts
    of any length are read whole; an empty table gives an empty result; all
    columns stay, under any names.
    """
    docs, back = shielded(docs, ["h1", "h2", "h1_", "h2_", "id_"])
    names = [f"`{c}`" for c in docs.columns]
    hashed = docs.withColumns(_hashed(F.col("text")))
    prints, classes = linked_classes(hashed.select("doc_id", "h1", "h2", "text"), similarity, shingle)
    best = classes.groupBy("root").agg(F.min(F.struct("best", "h1", "h2")).alias("best"))
    chosen = best.select(F.col("best.h1").alias("h1_"), F.col("best.h2").alias("h2_"), F.col("best.best.doc_id").alias("id_"))
    same = (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_")) & F.col("doc_id").eqNullSafe(F.col("id_"))
    rows = prints.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n"))
    judged = checkpointed(
        rows.join(chosen.withColumn("stays", F.lit(True)), same, "left").select(
            F.col("h1").alias("h1_"), F.col("h2").alias("h2_"), F.col("doc_id").alias("id_"), "n", F.coalesce("stays", F.lit(False)).alias("stays")
        )
    )
    gone, twice = judged.where("not stays").select("h1_", "h2_", "id_"), judged.where("stays and n > 1").select("h1_", "h2_", "id_")
    n_gone, n_twice = gone.count(), twice.count()
    kept = hashed.join(small_or_shuffled(gone, n_gone, 40), same, "left_anti")
    if not n_twice:
        return kept.select(*names).withColumnsRenamed(back)
    twice = small_or_shuffled(twice, n_twice, 40)
    double = kept.join(twice, same, "left_semi").dropDuplicates(["h1", "h2", "doc_id"])
    return kept.join(twice, same, "left_anti").select(*names).unionByName(double.select(*names)).withColumnsRenamed(back)
