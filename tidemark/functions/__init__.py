"""Scalar expressions that Spark has under another name or with other edge cases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def space_split(text: Column, sep: str = " ") -> Column:
    """Split at a literal separator; trailing empty parts are dropped, inner ones kept."""
    quoted = "".join(f"\\{c}" if c in r"\.[]{}()*+-?^$|" else c for c in sep)
    trimmed = F.regexp_replace(text, f"({quoted})+$", "")
    return F.split(trimmed, quoted)


def longest_length(words: Column) -> Column:
    """Length of the longest element; 0 for none."""
    return F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0))


def count_equal(words: Column, target: str) -> Column:
    """How many elements equal ``target`` exactly: no case folding, no stripping of punctuation."""
    return F.size(F.filter(words, lambda w: w == target))


def capitalized(text: Column) -> Column:
    """First letter in upper case, the rest untouched."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def full_name(first: Column, middle: Column, last: Column) -> Column:
    """The parts joined by spaces, without the missing ones."""
    return F.concat_ws(" ", first, middle, last)


def passed(best: Column, threshold: float = 9.0, inclusive: bool = True, yes: str = "PASSED", no: str = "FAILED") -> Column:
    """A label by threshold; null for a null."""
    test = best >= threshold if inclusive else best > threshold
    return F.when(best.isNull(), None).when(test, yes).otherwise(no)


def ticks(value: Column, scale: int) -> Column:
    """A decimal fraction as a whole number of 1/scale, so that equality and neighbours are exact."""
    return F.round(value * scale).cast("long")
