"""Frames and hops of signals. A signal is (track, n, ...): n counts the samples of a track from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame_count(n: Column, window: int, hop: int) -> Column:
    """Whole frames of n samples."""
    return F.when(n < window, F.lit(0).cast("bigint")).otherwise(F.floor((n - window) / hop) + 1)


def lengths(signals: DataFrame) -> DataFrame:
    return signals.groupBy("track").agg(F.count("*").alias("length"))


def frames(signals: DataFrame, window: int, hop: int, *aggregates: Column, strict: bool = False) -> DataFrame:
    """Aggregates of each whole frame: (track, frame, aggregates).

    Each sample goes to the frames that hold it, and sums are partial before the shuffle. A frame is whole if it has all
    its samples; with ``strict`` it must also end before the track's last sample, as loops that ask for pos + window < length do.
    """
    first = F.greatest(F.ceil((F.col("n") - window + 1) / hop), F.lit(0).cast("bigint"))
    spread = signals.withColumn("frame", F.explode(F.sequence(first, F.floor(F.col("n") / hop)))) if hop < window else signals.withColumn("frame", F.floor(F.col("n") / hop)).where(F.col("n") - F.col("frame") * hop < window)
    made = spread.groupBy("track", "frame").agg(F.count("*").alias("__n"), *aggregates).where(F.col("__n") == window).drop("__n")
    if strict:
        made = made.join(lengths(signals), "track").where(F.col("frame") * hop + window < F.col("length")).drop("length")
    return made


def hops(signals: DataFrame, hop: int, *aggregates: Column) -> DataFrame:
    """Partial aggregates of tumbling hops: (track, hop, size, aggregates), for windows that are whole numbers of hops."""
    return signals.groupBy("track", F.floor(F.col("n") / hop).alias("hop")).agg(F.count("*").alias("size"), *aggregates)


def sliding_sums(parts: DataFrame, hop: int, count: int, *columns: str) -> DataFrame:
    """Sums of ``count`` hops from each hop on that has as many whole ones after it."""
    over = Window.partitionBy("track").orderBy("hop").rowsBetween(0, count - 1)
    made = parts.withColumns({c: F.sum(c).over(over) for c in ("size", *columns)})
    return made.where(F.col("size") == hop * count)


def hann(window: int) -> Column:
    """Symmetric Hann window as an array column."""
    return F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda i: 0.5 * (1 - F.cos(2 * F.pi() * i / (window - 1))))


def blackman_harris(window: int) -> Column:
    """Four-term window; its weights are fixed values."""
    turn = lambda i, k: F.cos(2 * k * F.pi() * i / (window - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(window - 1)), lambda i: 0.35875 - 0.48829 * turn(i, 1) + 0.14128 * turn(i, 2) - 0.01168 * turn(i, 3))


def arrays(signals: DataFrame, *columns: str) -> DataFrame:
    """One row per track with its samples in order, for kernels that need a whole track."""
    packed = signals.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("n", *columns))).alias("__s"))
    return packed.select("track", *[F.transform("__s", lambda x, c=c: x[c]).alias(c) for c in columns])


def evenly_spaced(length: Column, frame: int, count: int) -> Column:
    """Start places of ``count`` frames spread over a track; none if it is shorter than a frame."""
    step = F.floor((length - frame) / count)
    return F.when(length >= frame, F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: i * step))
