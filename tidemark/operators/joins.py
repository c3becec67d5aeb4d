"""Joins: the plain forms and the constructions Catalyst doesn't find by itself.

Sides are broadcast only by hint of the caller or by Spark's own measured
size; everything else is shuffled on its keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {
    "inner": "inner", "left_outer": "left", "left": "left", "right_outer": "right", "right": "right",
    "outer": "full", "full": "full", "full_outer": "full", "left_semi": "left_semi", "semi": "left_semi", "left_anti": "left_anti", "anti": "left_anti",
}


def equi(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Equality join on a condition (both keys stay) or on names (the key stays once)."""
    return left.join(right, on, KINDS[how])


def cross(left: DataFrame, right: DataFrame, drop_null: str | None = None) -> DataFrame:
    """All pairs. ``drop_null`` names a left column whose nulls go, as under a condition comparing it with itself."""
    return (left if drop_null is None else left.where(F.col(drop_null).isNotNull())).crossJoin(right)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's size, from its sources' statistics; nothing is run. Unknown sizes are huge."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_join(big: DataFrame, small: DataFrame, on, how: str = "inner", max_bytes: int = 32 << 20) -> DataFrame:
    """Send the small side to every executor if it is estimated at ``max_bytes`` or less.

    A larger side, or one of unknown size, has no hint: adaptive execution
    broadcasts it if its measured size is small, and shuffles it otherwise.
    """
    return big.join(F.broadcast(small) if estimated_bytes(small) <= max_bytes else small, on, how)


def merge_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Force a sort-merge join."""
    return left.hint("merge").join(right, on, how)


def co_partitioned(left: DataFrame, right: DataFrame, key: str, partitions: int | None = None, how: str = "inner") -> DataFrame:
    """Shuffle both sides once on the key, with one partitioner that later steps on the key reuse."""
    args = (partitions, key) if partitions else (key,)
    return left.repartition(*args).join(right.repartition(*args), key, how)


def contains_join(left: DataFrame, right: DataFrame, array: str, key: str, exploded: bool = True) -> DataFrame:
    """Pairs where the left array contains the right key.

    The exploded form is an equality join on the distinct elements; the other
    is a nested loop. Both give a pair once, however often the array repeats
    the element; null elements and null arrays match nothing.
    """
    if not exploded:
        return left.join(right, F.array_contains(left[array], right[key]))
    element = "_element"
    spread = left.withColumn(element, F.explode(F.array_distinct(array)))
    return spread.join(right, spread[element] == right[key]).drop(element)


def band_join(left: DataFrame, right: DataFrame, on: list[str], value: str, width: float, other: str | None = None, naive: bool = False) -> DataFrame:
    """Equal keys and values at most ``width`` apart; columns of the right side get the suffix ``_r``.

    The naive form filters all pairs of a key. The other cuts values into cells
    a little wider than ``width``, gives each right row to its three
    neighbouring cells, joins on keys and cell, and checks the distance again:
    the same rows, but a frequent key is spread over its cells. Null keys or
    values match nothing.
    """
    if width <= 0:
        raise ValueError("width must be positive")
    other = other or value
    named = right.select(*[F.col(c).alias(f"{c}_r") for c in right.columns])
    near = F.abs(F.col(value) - F.col(f"{other}_r")) <= F.lit(width)
    same = [F.col(k) == F.col(f"{k}_r") for k in on]
    if naive:
        return left.join(named, _all([*same, near]))
    cell = width * (1 + 1e-9)
    left_cell = left.withColumn("_cell", F.floor(F.col(value) / F.lit(cell)))
    home = F.floor(F.col(f"{other}_r") / F.lit(cell))
    right_cells = named.withColumn("_cell_r", F.explode(F.array(home - 1, home, home + 1)))
    return left_cell.join(right_cells, _all([*same, F.col("_cell") == F.col("_cell_r"), near])).drop("_cell", "_cell_r")


def tick_join(left: DataFrame, right: DataFrame, on: list[str], value: str, scale: int, steps: int = 1) -> DataFrame:
    """Band join for decimal fractions: values become whole numbers of 1/scale, and neighbours are equal ticks.

    Exact where binary fractions aren't: 3.1 and 3.2 are one step of 0.1 apart.
    """
    named = right.select(*[F.col(c).alias(f"{c}_r") for c in right.columns])
    tick = F.round(F.col(f"{value}_r") * scale).cast("long")
    spread = named.withColumn("_tick_r", F.explode(F.sequence(tick - steps, tick + steps)))
    same = [F.col(k) == F.col(f"{k}_r") for k in on]
    home = left.withColumn("_tick", F.round(F.col(value) * scale).cast("long"))
    return home.join(spread, _all([*same, F.col("_tick") == F.col("_tick_r")])).drop("_tick", "_tick_r")


def tick_aggregate(left: DataFrame, right: DataFrame, on: list[str], value: str, scale: int, measure: str, steps: int = 1) -> DataFrame:
    """Sum, count and mean of ``measure`` over each left row's neighbours, without forming the pairs.

    The right side is summed per key and tick, a tick's sums are added to its
    neighbours', and each left row looks up one row: linear where ``tick_join``
    is quadratic in a hot key. Left rows without neighbours go, as in the join.
    """
    tick = F.round(F.col(value) * scale).cast("long").alias("_tick")
    known = right.where(F.col(value).isNotNull())
    sums = known.groupBy(*on, tick).agg(F.sum(measure).alias("s"), F.count(measure).alias("n"), F.count("*").alias("pairs"))
    near = F.explode(F.sequence(F.col("_tick") - steps, F.col("_tick") + steps)).alias("_tick")
    spread = sums.select(*on, near, "s", "n", "pairs").groupBy(*on, "_tick").agg(*[F.sum(c).alias(f"{c}_r") for c in ("s", "n", "pairs")])
    joined = left.withColumn("_tick", F.round(F.col(value) * scale).cast("long")).join(spread, [*on, "_tick"])
    mean = (F.col("s_r") / F.when(F.col("n_r") > 0, F.col("n_r"))).alias(f"mean_{measure}")
    return joined.select(*left.columns, F.col("s_r").alias(f"sum_{measure}"), F.col("pairs_r").alias("n_near"), mean)


def band_aggregate(left: DataFrame, right: DataFrame, on: list[str], value: str, measure: str, near: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Sum, count and mean of ``measure`` over each left row's band, with pairs only between distinct values.

    ``near`` is a band join of two frames with columns ``on`` and ``value``, in
    any of its forms. It gets the left side's distinct keys and values and the
    right side's sums for each of its own, so a frequent key or value costs a
    row per distinct value, whatever its rows. Each left row looks up one row;
    those without neighbours, or with null keys or values, go, as in the join.
    """
    points = left.select(*on, value).where(F.col(value).isNotNull()).distinct()
    sums = right.where(F.col(value).isNotNull()).groupBy(*on, value).agg(F.sum(measure).alias("_s"), F.count(measure).alias("_n"), F.count("*").alias("_pairs"))
    found = near(points, sums).groupBy(*on, value).agg(*[F.sum(f"{c}_r").alias(c) for c in ("_s", "_n", "_pairs")])
    mean = (F.col("_s") / F.when(F.col("_n") > 0, F.col("_n"))).alias(f"mean_{measure}")
    return left.join(found, [*on, value]).select(*left.columns, F.col("_s").alias(f"sum_{measure}"), F.col("_pairs").alias("n_near"), mean)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def multi_cogroup(inputs: dict[str, DataFrame], key: str, aggregates: dict[str, Column], how: str = "outer") -> DataFrame:
    """N relations by one exchange: a tagged union, then one aggregation per key.

    ``aggregates`` are over the union's columns; each relation has its own
    (others are null). ``how``: ``outer`` keeps all keys, ``inner`` those that
    every relation has. Null keys form no group.
    """
    tagged = [df.withColumn("_from", F.lit(name)) for name, df in inputs.items()]
    union = tagged[0]
    for df in tagged[1:]:
        union = union.unionByName(df, allowMissingColumns=True)
    present = {f"_has_{name}": F.max((F.col("_from") == name).cast("int")) for name in inputs}
    grouped = union.where(F.col(key).isNotNull()).groupBy(key).agg(*[c.alias(n) for n, c in (aggregates | present).items()])
    if how == "inner":
        grouped = grouped.where(_all([F.col(n) == 1 for n in present]))
    return grouped.drop(*present)


def pre_aggregated_max(facts: DataFrame, dims: DataFrame, key: str, value: str, above: float | None = None, inclusive: bool = False) -> DataFrame:
    """Each key's largest value joined to ``dims``, aggregated and filtered before the join.

    A group's maximum passes ``above`` only if one of its rows does, so rows
    are filtered before they are aggregated. Columns: those of ``dims`` and best.
    """
    if above is not None:
        facts = facts.where(F.col(value) >= above if inclusive else F.col(value) > above)
    return dims.join(facts.groupBy(key).agg(F.max(value).alias("best")), key)


def salted(left: DataFrame, right: DataFrame, key: str, salts: int, how: str = "inner", hot: list | None = None) -> DataFrame:
    """Join with hot keys on the left: their rows are spread over ``salts`` parts by position, the right side's are repeated for each.

    ``hot``: the keys in question (``partitioning.skew_report`` finds them);
    without it all keys are spread. Equal rows are spread too. For joins that
    keep no unmatched right rows (inner, left, semi, anti).
    """
    if KINDS[how] in ("right", "full"):
        raise ValueError("unmatched right rows would be repeated")
    none, every = F.lit(0).cast("long"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))
    is_hot = F.lit(True) if hot is None else F.coalesce(F.col(key).isin(hot), F.lit(False))
    spread = left.withColumn("_salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(salts))).otherwise(none))
    copies = right.withColumn("_salt", F.explode(F.when(is_hot, every).otherwise(F.array(none))))
    return spread.join(copies, [key, "_salt"], KINDS[how]).drop("_salt")


def salts_for(rows_of_hottest: int, target_rows: int = 5_000_000) -> int:
    """How many parts bring the hottest key's rows under ``target_rows`` each."""
    return max(1, math.ceil(rows_of_hottest / target_rows))
