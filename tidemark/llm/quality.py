"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; its failure is one bit of a mask
that is stored beside the measurements. Policies are versioned sets of rules
that are applied to stored masks, and ablations (what a rule drops alone, what
it would let through) are bitwise aggregates over the masks. Only DataFrame
functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, shielded, words


@dataclass(frozen=True)
class Rule:
    """``fails``: SQL over the measurements, true where a document fails. ``bit`` never changes its meaning."""

    bit: int
    name: str
    fails: str


#: The measurements are whole numbers and the tests are products, so that any engine gets the same verdict.
RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "exclamations", "10 * n_exclaims > 3 * n_words"),
    Rule(5, "capitals", "2 * n_capitals > n_letters"),
    Rule(6, "short_words", "word_chars < 2 * n_words"),
    Rule(7, "long_words", "word_chars > 15 * n_words"),
    Rule(8, "many_words", "n_words > 1000000"),
    Rule(9, "bullet_lines", "10 * n_bullet_lines > 9 * n_lines"),
)
BASE = ("few_words", "repeated_words")
#: Policy versions; a version is never changed once it has been used.
POLICIES = {1: BASE, 2: tuple(rule.name for rule in RULES)}
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_exclaims", "n_capitals", "n_letters", "n_bullet_lines",
)


def policy_mask(names) -> int:
    bits = {rule.name: rule.bit for rule in RULES}
    return sum(1 << bits[name] for name in set(names))


def measured(docs: DataFrame) -> DataFrame:
    """The documents' other columns with MEASURES (long) in place of ``text``.

    Words: runs without ASCII white space. ``n_repeat_words`` counts words that
    lie in a window of three words found twice or more in the text; windows are
    told apart by 64-bit hashes, sorted with their positions within the row, so
    no word leaves its row. A null or empty text measures 0 throughout; texts
    of any length are measured whole; repeated rows and an empty table give as
    many rows. Columns of ``docs`` with the names added here are replaced, all
    others stay.
    """
    docs, back = shielded(docs.drop(*MEASURES), ["_words", "_lines", "_windows", "_starts"])
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text"), F.lit(""))
    rid = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    read = docs.select(
        *kept,
        words(text).alias("_words"),
        lines.alias("_lines"),
        rid(SPACE).alias("word_chars"),
        rid(r"[^#*$%&|<>]+").alias("n_symbols"),
        rid(r"[^!]+").alias("n_exclaims"),
        rid(r"[^A-Z]+").alias("n_capitals"),
        rid(r"[^A-Za-z]+").alias("n_letters"),
    )
    windows = F.transform(
        F.when(F.size("_words") >= 3, F.sequence(F.lit(0), F.size("_words") - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")
        ),
    )
    hashed = read.select(
        *kept,
        F.size("_words").alias("n_words"),
        *["word_chars", "n_symbols", "n_exclaims", "n_capitals", "n_letters"],
        F.size("_lines").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*([-*]|\x{2022})"))).alias("n_bullet_lines"),
        F.sort_array(windows).alias("_windows"),
    )
    repeated = F.filter(
        "_windows",
        lambda x, k: (x["h"] == F.get("_windows", k - 1)["h"]) | (x["h"] == F.get("_windows", k + 1)["h"]),
    )
    starts = hashed.withColumn("_starts", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("_starts", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_starts", k + 1) - x, F.lit(3)))),
        F.lit(0),
        lambda total, x: total + x,
    )
    return starts.withColumn("n_repeat_words", covered).select(*kept, *[F.col(c).cast("long").alias(c) for c in MEASURES]).withColumnsRenamed(back)


def ledger(docs: DataFrame, rules=RULES) -> DataFrame:
    """``measured(docs)`` with ``failures``: bit b is set where the rule of bit b fails. A null verdict is no failure."""
    mask = F.lit(0).cast("long")
    for rule in rules:
        mask = mask.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return measured(docs).withColumn("failures", mask)


def failed(mask: int):
    return F.col("failures").bitwiseAND(F.lit(mask)) != 0


def apply_policy(book: DataFrame, version: int = 2, policies=POLICIES) -> DataFrame:
    """The ledger with ``kept``: whether no rule of that policy version failed. Nothing is measured anew."""
    return book.withColumn("kept", ~failed(policy_mask(policies[version])))


def ablations(book: DataFrame, version: int = 2, rules=RULES, policies=POLICIES) -> DataFrame:
    """Per rule of a policy: rule, n_failed, n_only (dropped by it alone: what its removal lets through), n_bits.

    Masks are counted first, so at most 2**len(rules) rows are combined.
    """
    mask = policy_mask(policies[version])
    counts = book.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    named = [rule for rule in rules if rule.name in policies[version]]
    per_rule = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in named]))
    had = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return (
        counts.select("bits", "n", per_rule.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(had, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(had, F.col("n") * F.bit_count("bits")).otherwise(0)).alias("n_bits"),
        )
    )
