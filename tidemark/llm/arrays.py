"""Array expressions whose cost is in proportion to the array: binding, running sums, and cutting long texts.

A lambda's body is evaluated for every element, with all that the optimizer
has moved into it. So bodies here refer to lambda variables only, and ``let``
makes one of any expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are summed one by one before their sum is passed on; code points of a chunk of text.
BLOCK, CHUNK = 256, 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _grown(block: Column, start: Column, combine) -> Column:
    """Running values of a short array, each without its own element."""
    return F.aggregate(
        block,
        F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
        lambda acc: acc["out"],
    )


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each of the whole numbers (array<int>) what ``combine`` makes of those before it, beginning at 0.

    ``combine`` is associative and takes 0 as neutral (a sum, or the greatest
    of numbers that aren't negative). Blocks are combined first, then each goes
    on from those before it, so that no long array is grown step by step.
    """
    zero = F.lit(0)

    def blocks(v: Column) -> Column:
        starts = F.sequence(zero, F.greatest(F.size(v) - 1, zero), F.lit(BLOCK))
        return F.transform(starts, lambda at: F.slice(v, at + 1, F.lit(BLOCK)))

    def joined(parts: Column) -> Column:
        before = _grown(F.transform(parts, lambda p: F.aggregate(p, zero, combine)), zero, combine)
        return F.flatten(F.transform(F.arrays_zip(parts.alias("p"), before.alias("b")), lambda z: _grown(z["p"], z["b"], combine)))

    return let(let(values, blocks), joined)


def chunked(text: Column) -> Column:
    """A text as an array of chunks of CHUNK code points."""
    return F.when(F.length(text) <= CHUNK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)))


def cut(chunks: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to before ``end`` of a text in chunks; empty if there are none.

    Only the chunks concerned are touched, where ``substring`` would walk the text from its beginning.
    """
    first = F.floor(start / CHUNK).cast("int")
    count = F.floor((end - 1) / CHUNK).cast("int") - first + 1
    near = F.array_join(F.slice(chunks, first + 1, F.greatest(count, F.lit(0))), "")
    return F.when(end > start, F.substring(near, start % CHUNK + 1, end - start)).otherwise(F.lit(""))
