"""Mixing sources to target weights.

Tokens are aggregated per source, target sizes become repetition rates, and
each document is emitted floor(rate) times plus one more copy with probability
equal to the fraction, decided by a hash of the document and a seed. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, shielded, small_or_shuffled, word_count

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
ADDED = ("size", "source_size", "target", "rate", "copies")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sized`` (source, size) to one row per source: source, source_size, target.

    Sources in code-point order, null last, take the weights in turn and share
    ``share`` times all sizes. A target stops at ``cap`` times its source; the
    excess goes to the others by weight until none is above. That fixed point
    is found in closed form: with sources by cap/weight, the level after the
    first i caps is (budget - their caps) / (weights left), and the first
    source whose cap/weight reaches its level ends the capped prefix.

    The windows run over one row per source, in running frames that hold no
    partition in memory; only three sums come to the driver.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per_source = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
    )
    per_source = checkpointed(per_source)
    all_size, all_weight = per_source.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(float(share)) * F.lit(all_size or 0) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.lit(all_weight or 0.0) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = per_source.withColumn("level", level).where("ratio >= level")
    final = levels.agg(F.min(F.struct("ratio", "level"))["level"]).first()[0]
    target = F.col("most") if final is None else F.least("most", F.lit(final) * F.col("weight"))
    return per_source.select("source", "source_size", target.alias("target"))


def uniform(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 over seed and columns (null: empty)."""
    key = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rated(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, share=SHARE, cap=CAP, seed: str = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target, rate and copies.

    Each document's copies are floor(rate), plus one where its hash lies under
    the fraction. Rows equal in doc_id, source and size decide alike (nulls
    are equal); a null or empty text has size 0, and texts of any length are
    counted whole; null is a source of its own, last in order; a source of size
    0 has rate 0; sources that tie in cap/weight are taken by name; an empty
    table gives an empty result. Columns of ``docs`` with the names added here
    are replaced, all others stay.

    The source table is measured before it is broadcast; a larger one is joined
    by shuffling, where adaptive execution splits a hot source.
    """
    docs, back = shielded(docs.drop(*ADDED), ["_source"])
    sized = docs.withColumn("size", word_count(F.col("text")) if size is None else size)
    targets = checkpointed(source_targets(sized.select("source", "size"), weights, share, cap))
    rows, name = targets.agg(F.count("*"), F.coalesce(F.max(F.octet_length("source")), F.lit(0))).first()
    targets = targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    targets = small_or_shuffled(targets.withColumnRenamed("source", "_source"), rows, name + 64)
    whole = F.floor("rate")
    extra = (uniform(seed, F.col("doc_id"), F.col("source"), F.col("size")) < F.col("rate") - whole).cast("long")
    return (
        sized.join(targets, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("copies", (whole + extra).cast("long"))
        .withColumnsRenamed(back)
    )


def mixed(docs: DataFrame, **kwargs) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it was drawn, with all its own columns and no others.

    Columns that have names of those added while mixing keep their values.
    """
    docs, back = shielded(docs, [*ADDED, "_source", "_copy"])
    names = docs.columns
    drawn = rated(docs, **kwargs).where("copies > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return drawn.withColumn("_copy", copies).select(*[f"`{c}`" for c in names]).withColumnsRenamed(back)
