"""As-of joins by level: the first later value of a series that is at or below an event's own level, at any distance.

A series (track, n, x) counts n from 0 without gaps and has no nulls. It is laid into blocks of arrays. An event looks through the rest of its
own block; one that finds nothing there looks through the least values of the track's blocks, one number each, and then through the one
block that these name. A search in an array goes by least values of stretches of 1, 2, 4, ... elements, so it takes as many steps as the
length has bits, and no event meets the rows between it and what it finds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ondine.staging import staged

#: Values of a block.
BLOCK = 1 << 16


def laid(series: DataFrame, block: int = BLOCK, reach: int = 0) -> DataFrame:
    """(track, block, x): arrays of a block's values and of the ``reach`` values after them."""
    own = F.floor(F.col("n") / block)
    if reach:
        own = F.explode(F.sequence(F.greatest(F.floor((F.col("n") - reach) / block), F.lit(0).cast("bigint")), own))
    rows = series.select("track", "n", "x", own.alias("block"))
    packed = rows.groupBy("track", "block").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("s"))
    return packed.select("track", "block", F.transform("s", lambda v: v["x"]).alias("x"))


def first_below(x: np.ndarray, after: np.ndarray, level: np.ndarray) -> np.ndarray:
    """For each event the first place behind ``after`` (-1: from the start) where x is at or below ``level``; -1 where there is none."""
    least = [x]
    while 1 << len(least) <= len(x):
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    at = after + 1
    for k in reversed(range(len(least))):
        whole = at + (1 << k) <= len(x)
        above = whole & (least[k][np.where(whole, at, 0)] > level) if len(x) else whole
        at = at + (above.astype(np.int64) << k)
    return np.where(at < len(x), at, -1)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _search(x: pd.Series, after: pd.Series, level: pd.Series) -> pd.Series:
    return pd.Series([first_below(np.asarray(a, np.float64), np.asarray(b, np.int64), np.asarray(c, np.float64)) for a, b, c in zip(x, after, level)])


def _meet(arrays: DataFrame, events: DataFrame, keys: list[str], after: str) -> DataFrame:
    """Events with ``place``: what the search in the array of their keys finds."""
    packed = events.groupBy(*keys).agg(F.collect_list(F.struct("track", "at", "level", "block", F.col(after).alias("after"))).alias("e"))
    met = packed.join(arrays, keys)
    found = met.select("e", _search("x", F.transform("e", lambda v: v["after"]), F.transform("e", lambda v: v["level"])).alias("p"))
    return found.select(F.explode(F.arrays_zip("e", "p")).alias("z")).select("z.e.track", "z.e.at", "z.e.level", "z.e.block", F.col("z.p").alias("place"))


def first_at_or_below(series: DataFrame, events: DataFrame, block: int = BLOCK) -> DataFrame:
    """(track, at, level, found): of each distinct event (track, at, level) the first place behind ``at`` with a value at or below ``level``.

    ``found`` is null where there is none, where the level is null and where the track or the place is not in the series.
    """
    arrays = staged(laid(series, block), "laid")
    own = events.select("track", F.col("at").cast("bigint").alias("at"), F.col("level").cast("double").alias("level")).distinct()
    asked = staged(own.withColumn("block", F.floor(F.col("at") / block)), "asked")
    valid = asked.where("level is not null and at >= 0").withColumn("after", F.col("at") % block)
    first = staged(_meet(arrays, valid, ["track", "block"], "after"), "first")
    inside = first.where("place >= 0").select("track", "at", "level", (F.col("block") * block + F.col("place")).alias("found"))
    open_ = first.where("place < 0")
    # (track, x): least values of a track's blocks, in order; open events of one block meet them together
    minima = arrays.select("track", "block", F.array_min("x").alias("m")).groupBy("track").agg(F.sort_array(F.collect_list(F.struct("block", "m"))).alias("s"))
    minima = minima.select("track", F.transform("s", lambda v: v["m"]).alias("x"))
    each = open_.select("track", "block").distinct().join(minima, "track")
    later = _meet(each, open_.drop("place"), ["track", "block"], "block").where("place >= 0")
    last = _meet(arrays, later.select("track", "at", "level", F.col("place").alias("block"), F.lit(-1).cast("bigint").alias("start")), ["track", "block"], "start")
    outside = last.select("track", "at", "level", (F.col("block") * block + F.col("place")).alias("found"))
    return asked.drop("block").join(inside.unionByName(outside), ["track", "at", "level"], "left")
