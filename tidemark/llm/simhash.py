"""SimHash near-duplicates by pivot distance tables.

Every fingerprint's Hamming distances to many reference fingerprints (pivots)
are computed once. Two fingerprints within k bits differ by at most k in every
coordinate of that table, so a pair is discarded as soon as one coordinate
differs by more, and only the survivors are compared bit by bit. (``simhash_wide`` has the wider radius of near-duplicate
removal, where pivots can't discard anything.)

Pivots discard pairs; they don't say which pairs to form. So that never all
pairs are formed, fingerprints meet in buckets: of six blocks of bits three are
equal in any pair within three bits, which gives twenty keys of 31 to 33 bits.
Buckets over a limit are split in the same way over the bits outside the key,
into parts that share 47 bits or more and so hold 2**17 fingerprints at most.
Within a bucket rows are sorted by the first coordinate, and a row is compared
with those that follow it within k. A bucket gives a spanning forest of its
links, not its pairs; connected components follow by star contraction over
tables in the shared checkpoint folder. Nothing of the corpus comes to the
driver except counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, small_or_shuffled

SEED = 42
SHINGLE = 3
BITS = 3
PIVOTS = 16
#: A bucket with more fingerprints is split over the bits outside its key.
BUCKET = 4096
_CHUNK = 1 << 16
_ALL = (1 << 64) - 1


def pivots(count: int = PIVOTS) -> list[int]:
    """Reference fingerprints: the hashes of the numbers from 0."""
    return [xxhash.xxh64_intdigest(str(i).encode(), seed=SEED) for i in range(count)]


def _masks(bits: list[int]) -> list[int]:
    """Six blocks of the given bit positions; the masks of all threes."""
    parts = np.array_split(np.array(bits, dtype=object), 6)
    blocks = [sum(1 << int(b) for b in part) for part in parts]
    return [a | b | c for a, b, c in combinations(blocks, 3)]


MASKS = _masks(list(range(64)))
SUBMASKS = [m | s for m in MASKS for s in _masks([b for b in range(64) if not m >> b & 1])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    count = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, _CHUNK):
        part = words[at : min(at + _CHUNK, count) + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        n = min(_CHUNK, count - at)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def fingerprinted(docs: DataFrame, name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with its fingerprint as a signed long in ``name`` (replaced if there)."""

    @F.pandas_udf("long")
    def of(texts):
        return texts.map(lambda x: signed(fingerprint(x, shingle))).astype("int64")

    return docs.withColumn(name, of(F.col("text")))


def _keyed(prints: DataFrame, limit: int) -> DataFrame:
    """fp to the buckets it lies in: b, key, d0 (first coordinate), and the pivot table in words of eight bytes."""
    table = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(p)))).cast("long") for p in pivots()]
    packs = []
    for at in range(0, PIVOTS, 8):
        pack = F.lit(0).cast("long")
        for j, d in enumerate(table[at : at + 8]):
            pack = pack.bitwiseOR(F.shiftleft(d, 8 * j))
        packs.append(pack.alias(f"t{at // 8}"))
    tabled = prints.select("fp", *packs)
    keys = F.array(*[F.struct(F.lit(b).alias("b"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for b, m in enumerate(MASKS)])
    keyed = tabled.withColumn("k", F.explode(keys)).select("fp", *[f"t{i}" for i in range(PIVOTS // 8)], "k.b", "k.key")
    hot = checkpointed(keyed.groupBy("b", "key").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("b", "key"))
    rows = hot.count()
    if rows:
        within = F.array(
            *[
                F.struct(
                    (F.col("b") * 20 + s + len(MASKS)).cast("int").alias("b"),
                    F.col("fp").bitwiseAND(F.element_at(F.lit([signed(SUBMASKS[b * 20 + s]) for b in range(20)]), F.col("b") + 1)).alias("key"),
                )
                for s in range(20)
            ]
        )
        hot = small_or_shuffled(hot.withColumn("hot", F.lit(True)), rows, 24)
        keyed = (
            keyed.join(hot, ["b", "key"], "left")
            .withColumn("k", F.explode(F.when(F.col("hot"), within).otherwise(F.array(F.struct(F.col("b").alias("b"), F.col("key").alias("key"))))))
            .select("fp", *[f"t{i}" for i in range(PIVOTS // 8)], "k.b", "k.key")
        )
    return keyed.withColumn("d0", F.col("t0").bitwiseAND(F.lit(255)).cast("int"))


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = parent[x]
    while True:
        up = parent[r]
        if np.array_equal(up, r):
            return r
        r = up


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while len(i):
        a, b = _roots(parent, i), _roots(parent, j)
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def forest(run: np.ndarray, prints: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """Roots of the rows' linked groups. ``run`` numbers the buckets; rows are sorted by bucket, then first coordinate."""
    n = len(run)
    parent = np.arange(n)
    first = table[:, 0]
    for at in range(0, n, 1 << 18):
        act = np.arange(at, min(n, at + (1 << 18)))
        step = 0
        while len(act):
            step += 1
            act = act[: np.searchsorted(act, n - step)]
            other = act + step
            near = (run[act] == run[other]) & (first[other] - first[act] <= bits)
            act = act[near]
            i, j = act, act + step
            for c in range(1, table.shape[1]):
                if not len(i):
                    break
                close = np.abs(table[i, c] - table[j, c]) <= bits
                i, j = i[close], j[close]
            if len(i):
                same = np.bitwise_count(prints[i] ^ prints[j]) <= bits
                _unite(parent, i[same], j[same])
    return _roots(parent, np.arange(n))


def links(prints: DataFrame, bits: int = BITS, limit: int = BUCKET) -> DataFrame:
    """Distinct ``fp`` to (u, v): links of at most ``bits`` differing bits that connect all that are linked at all.

    ``bits`` may be 3 or less, for which the keys lose no pair. Every bucket
    gives each of its fingerprints at most one row.
    """
    if not 0 <= bits <= 3:
        raise ValueError("the keys are exact up to 3 bits")
    words = [f"t{i}" for i in range(PIVOTS // 8)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def solved(columns: list[np.ndarray]) -> pa.RecordBatch:
            b, key, fp, *packs = columns
            number = np.cumsum(np.append(False, (b[1:] != b[:-1]) | (key[1:] != key[:-1])))
            table = np.stack(packs, axis=1).astype("<i8").view(np.uint8).reshape(len(fp), -1).astype(np.int16)
            root = forest(number, fp.view(np.uint64), table, bits)
            moved = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            held.append(columns)
            b, key = columns[0], columns[1]
            if held[0][0][0] == b[-1] and held[0][1][0] == key[-1]:
                continue  # one bucket so far
            done = [np.concatenate(c) for c in zip(*held)]
            cut = np.flatnonzero((done[0] != b[-1]) | (done[1] != key[-1]))[-1] + 1
            yield solved([c[:cut] for c in done])
            held = [[c[cut:] for c in done]]
        if held:
            yield solved([np.concatenate(c) for c in zip(*held)])

    keyed = _keyed(prints, limit).repartition("b", "key").sortWithinPartitions("b", "key", "d0", "fp")
    return keyed.select("b", "key", "fp", *words).mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) to (node, root): the smallest node that is reachable, for every node of an edge.

    Large-star and small-star steps by turns, until a round changes nothing.
    Each is a minimum per node (combined before the exchange) joined back to
    the edges, so a hub's edges are split by adaptive execution and are never
    gathered. Every round is checkpointed.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("v"), F.col("u"))).toDF("u", "v") if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        joined = both.join(low, F.col("u") == F.col("n"))
        if large:
            new = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            new = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select(F.col("n").alias("u"), F.col("m").alias("v")))
        return new.where("u <> v").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = checkpointed(edges.where("u <> v"))
    before = None
    while (after := mark(now)) != before:
        before = after
        if not after[0]:
            break
        now = checkpointed(star(star(now, True), False))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def _classes(printed: DataFrame, bits: int, limit: int) -> DataFrame:
    """(doc_id, fp) rows to one row per fingerprint: fp, root, component_id, best_fp (that of the smallest id)."""
    reps = checkpointed(printed.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    member = components(links(reps.select("fp"), bits, limit))
    rooted = checkpointed(reps.join(member, reps["fp"] == member["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "rep"))
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "fp")).alias("best"))
    return rooted.join(best, "root").select(
        "fp", "root", F.col("best.rep").alias("component_id"), F.col("best.fp").alias("best_fp")
    )


def clusters(docs: DataFrame, bits: int = BITS, limit: int = BUCKET, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, fingerprint (16 hex digits), component_id, component_root.

    One row per input row. ``component_id`` is the smallest doc_id reachable
    over links (null if all of a component's ids are null), ``component_root``
    a fingerprint of the component. Texts without words (null, empty) have
    fingerprint zero and link like any other; texts of any length are read
    whole; a bit set in exactly half of the hashes is 0; repeated rows and equal
    ids are kept as they are; an empty table gives an empty result; other
    columns are not read.
    """
    printed = checkpointed(fingerprinted(docs.select("doc_id", "text"), "fp", shingle).select("doc_id", "fp"))
    classes = checkpointed(_classes(printed, bits, limit)).withColumnRenamed("fp", "_fp")
    return printed.join(classes, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", F.col("root").alias("component_root")
    )
