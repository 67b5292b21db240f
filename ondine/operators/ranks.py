"""Exact order statistics of groups of any size, without a list of a group and without sorting it.

A mergeable sketch of each group gives two values between which a rank must lie. Values below the first are counted; those from the first to the
second, a few of every thousand, are counted by value, and a running sum over them ends at the rank. Both passes add up partially before their
shuffle, so a group with a large share of all rows costs no task more than others.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Rank(NamedTuple):
    """A place near ``share`` of a group's size; ``at`` gives it, from 0, from the size."""

    share: float
    at: Callable[[Column], Column]


def at_share(p: float) -> Rank:
    """floor(n p); nothing beyond the end."""
    return Rank(p, lambda n: F.floor(n * F.lit(p)))


def at_share_capped(p: float) -> Rank:
    """min(floor(n p), n - 1)."""
    return Rank(p, lambda n: F.least(F.floor(n * F.lit(p)), n - 1))


def worst_percent() -> Rank:
    """max(1, floor(n / 100)) - 1."""
    return Rank(0.01, lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(0.01))) - 1)


def exact_ranks(rows: DataFrame, keys: list[str], value: str, accuracy: int = 10_000, **ranks: Rank) -> DataFrame:
    """A row for each group: keys, size (values that are not null) and the value at each rank; null where the group has none.

    ``rows`` is read twice, so stage what is dear to make. The sketch errs by a ``accuracy``-th of a group at most, and the bounds lie three of these
    apart from the rank; groups no larger than ``accuracy`` take all of their values. Ties are one value with its count. Should a bound
    not hold, the query fails rather than give a wrong value. NaN counts as the largest value.
    """
    shares = [min(1.0, max(0.0, r.share + side * 3 / accuracy)) for r in ranks.values() for side in (-1, 1)]
    v = F.col(value)
    sketch = rows.groupBy(*keys).agg(F.count(v).alias("size"), F.min(v).alias("__least"), F.max(v).alias("__most"), F.percentile_approx(v, shares, accuracy).alias("__between"))
    few = F.col("size") <= accuracy
    bounds = sketch.select(
        *keys,
        "size",
        *[F.when(few, F.col("__least")).otherwise(F.col("__between")[2 * j]).alias(f"__low{j}") for j in range(len(ranks))],
        *[F.when(few, F.col("__most")).otherwise(F.col("__between")[2 * j + 1]).alias(f"__high{j}") for j in range(len(ranks))],
        *[r.at(F.col("size")).cast("bigint").alias(f"__want{j}") for j, r in enumerate(ranks.values())],
    )
    slot = lambda j: F.struct(F.lit(j).alias("slot"), F.when(v >= F.col(f"__low{j}"), v).alias("v"), F.col(f"__want{j}").alias("want"))
    near = rows.where(v.isNotNull()).join(bounds, keys)
    spread = near.select(*keys, F.explode(F.array_compact(F.array(*[F.when(v <= F.col(f"__high{j}"), slot(j)) for j in range(len(ranks))]))).alias("__s"))
    counts = spread.groupBy(*keys, "__s.slot", "__s.v", "__s.want").agg(F.count("*").alias("__c"))
    order = Window.partitionBy(*keys, "slot").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.withColumn("__run", F.sum("__c").over(order)).where(F.col("__run") > F.col("want"))
    broken = F.raise_error(F.lit("a rank lies outside the bounds of its sketch"))
    found = reached.groupBy(*keys).agg(*[F.when(F.bool_or((F.col("slot") == j) & F.col("v").isNull()), broken).otherwise(F.min(F.when(F.col("slot") == j, F.col("v")))).alias(name) for j, name in enumerate(ranks)])
    got = bounds.join(found, keys, "left")
    inside = lambda j: F.col(f"__want{j}").between(0, F.col("size") - 1)
    return got.select(*keys, "size", *[F.when(inside(j) & F.col(name).isNull(), broken).otherwise(F.col(name)).alias(name) for j, name in enumerate(ranks)])
