"""URL filters by a Bloom filter cascade.

A cascade answers membership in a list exactly for every key of a closed
universe, here all domains of the corpus's own hosts. Level 0 is a Bloom
filter of the listed keys; level 1 holds the unlisted keys that level 0 lets
through, level 2 the listed keys that level 1 lets through, and so on until no
key is wrong. Rows are then judged by hashing alone, without a join on the list.

Keys are split into shards by hash, so that every cascade is built from a
bounded group of distinct keys.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, shielded

#: Distinct keys per shard, about; bytes of cascades that are broadcast together; levels before giving up.
SHARD_KEYS, MOST_BYTES, MOST_LEVELS = 200_000, 64 << 20, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(line: str) -> UrlRule:
    """``allow org/`` or ``block example.org/en/1``: the host ends at the first slash."""
    verdict, _, target = line.partition(" ")
    host, slash, path = target.partition("/")
    if verdict not in ("allow", "block") or not host:
        raise ValueError(f"not a rule: {line!r}")
    return UrlRule(verdict, host, slash + path)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains_of(host: Column) -> Column:
    """A host and all its parent domains; none for an empty host."""
    labels = F.split(host, r"\.")
    all_ = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(host != "", all_).otherwise(F.array().cast("array<string>"))


def best_rule(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """Struct (text, verdict) of the longest rule that fits the host or a parent domain and starts the path; else null."""
    found = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.verdict == "allow")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def hashes_of(key: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes; 128 bits tell all keys of a universe apart."""
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(h1: np.ndarray, h2: np.ndarray, level: int, size: int, count: int) -> Iterator[np.ndarray]:
    salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    a, b = _mix(h1 + salt), _mix(h2 ^ salt) | np.uint64(1)
    for j in range(count):
        yield (a + np.uint64(j) * b) % np.uint64(size)


class Bloom:
    def __init__(self, h1: np.ndarray, h2: np.ndarray, level: int, rate: float):
        self.level = level
        self.count = max(1, round(-math.log2(rate)))
        self.size = max(64, math.ceil(len(h1) * self.count / math.log(2)))
        bits = np.zeros(self.size, bool)
        for at in _places(h1, h2, level, self.size, self.count):
            bits[at] = True
        self.bits = np.packbits(bits, bitorder="little")

    def holds(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        found = np.ones(len(h1), bool)
        for at in _places(h1, h2, self.level, self.size, self.count):
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found


def cascade(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> list[Bloom]:
    """Levels that give ``listed`` for every key. The first level's error rate balances its size with the rest."""
    levels: list[Bloom] = []
    own, other = np.flatnonzero(listed), np.flatnonzero(~listed)
    rate = min(0.5, math.sqrt(0.5) * len(own) / max(1, len(other))) if len(own) else 0.5
    while len(own):
        if len(levels) == MOST_LEVELS:
            raise ValueError("two keys of the universe have equal hashes")
        level = Bloom(h1[own], h2[own], len(levels), rate)
        levels.append(level)
        own, other, rate = other[level.holds(h1[other], h2[other])], own, 0.5
    return levels


def holds(levels: list[Bloom], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Membership, exact for keys of the universe: the parity of the first level that lacks the key."""
    found = np.zeros(len(h1), bool)
    act = np.arange(len(h1))
    for i, level in enumerate(levels):
        inside = level.holds(h1[act], h2[act])
        found[act[~inside]] = i % 2 == 1
        act = act[inside]
    found[act] = len(levels) % 2 == 1
    return found


def build(universe: DataFrame, listed: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """``universe`` (key) and ``listed`` (key), in any multiplicity, to (shard, blob) and the number of shards.

    Null keys are left out; listed keys outside the universe take no space.
    Equal keys are merged before the exchange, so a frequent one is one row.
    """
    marked = universe.select("key", F.lit(1).alias("u"), F.lit(0).alias("l")).union(listed.select("key", F.lit(0), F.lit(1)))
    keys = marked.where("key is not null").groupBy("key").agg(F.max("u").alias("u"), F.max("l").alias("l")).where("u = 1")
    h1, h2 = hashes_of(F.col("key"))
    hashed = checkpointed(keys.select(h1.alias("h1"), h2.alias("h2"), (F.col("l") == 1).alias("listed")))
    shards = max(1, -(-hashed.count() // shard_keys))

    def make(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        levels = cascade(group["h1"].to_numpy("int64").view("u8"), group["h2"].to_numpy("int64").view("u8"), group["listed"].to_numpy(bool))
        return pd.DataFrame({"shard": [key[0]], "blob": [pickle.dumps(levels)]})

    shard = F.pmod("h1", F.lit(shards)).cast("long")
    return checkpointed(hashed.withColumn("shard", shard).groupBy("shard").applyInPandas(make, "shard long, blob binary")), shards


def member(rows: DataFrame, keys: Column, cascades: DataFrame, shards: int, name: str = "listed", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``rows`` with ``name``: whether any of the ``keys`` (array) is listed. Null or no keys: false.

    Cascades up to ``most_bytes`` are broadcast; more are taken in blocks of at
    most that size, each a pass over the checkpointed rows.
    """
    context = rows.sparkSession.sparkContext
    sizes = [(r[0], r[1]) for r in cascades.select("shard", F.length("blob")).orderBy("shard").collect()]
    blocks: list[list[int]] = [[]]
    held = 0
    for shard, size in sizes:
        if held + size > most_bytes and blocks[-1]:
            blocks.append([])
            held = 0
        blocks[-1].append(shard)
        held += size
    h1 = F.transform(keys, lambda k: hashes_of(k)[0])
    h2 = F.transform(keys, lambda k: hashes_of(k)[1])
    rows = rows.withColumn(name, F.lit(False)).withColumn("_h1", h1).withColumn("_h2", h2)
    for number, block in enumerate(blocks):
        found = cascades.where(F.col("shard").isin(block)).collect() if block else []
        shared = context.broadcast({r[0]: pickle.loads(r[1]) for r in found})

        @F.arrow_udf("boolean")
        def test(a: pa.Array, b: pa.Array) -> pa.Array:
            counts = np.diff(a.offsets.to_numpy()) if len(a) else np.empty(0, np.int64)
            counts = np.where(a.is_null().to_numpy(zero_copy_only=False), 0, counts)
            x, y = a.flatten().to_numpy(zero_copy_only=False), b.flatten().to_numpy(zero_copy_only=False)
            own = np.mod(x, shards)
            hit = np.zeros(len(x), bool)
            for k, chain in shared.value.items():
                at = np.flatnonzero(own == k)
                hit[at] = holds(chain, x[at].view("u8"), y[at].view("u8"))
            row = np.repeat(np.arange(len(a)), counts)
            return pa.array(np.bincount(row[hit], minlength=len(a)) > 0)

        rows = rows.withColumn(name, F.col(name) | test("_h1", "_h2"))
        if number + 1 < len(blocks):
            rows = checkpointed(rows)
            shared.unpersist()
    return rows.drop("_h1", "_h2")


def judged(pages: DataFrame, listed: DataFrame, rules: list[str], shard_keys: int = SHARD_KEYS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``pages`` (url, ...) with host, path, rule, listed, verdict; columns of these names are replaced.

    The verdict is the longest fitting rule's (of rules with one text, allow),
    else block if the host or a parent domain is in ``listed`` (column key),
    else allow. Null urls and urls without ``://`` have an empty host, fit no
    rule and are allowed. Repeated rows are judged each; nulls and repeats in
    ``listed`` change nothing; an empty table gives an empty result; other
    columns stay, under any names.
    """
    rules_ = [parse_rule(line) for line in rules]
    pages, back = shielded(pages.drop("host", "path", "rule", "listed", "verdict"), ["_h1", "_h2", "_rule"])
    pages = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    # the domains are taken from distinct hosts, so that a frequent host is split into its parents once
    universe = pages.select("host").distinct().select(F.explode(domains_of(F.col("host"))).alias("key"))
    cascades, shards = build(universe, listed, shard_keys)
    rule = best_rule(F.col("host"), F.col("path"), rules_)
    return (
        member(pages, domains_of(F.col("host")), cascades, shards, "listed", most_bytes)
        .withColumn("_rule", rule)
        .withColumn("rule", F.col("_rule.text"))
        .withColumn("verdict", F.coalesce("_rule.verdict", F.when(F.col("listed"), "block").otherwise("allow")))
        .drop("_rule")
        .withColumnsRenamed(back)
    )
