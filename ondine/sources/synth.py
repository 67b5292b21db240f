"""Test signals in closed form, made where they are needed: no table is sent from the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ondine.functions.scalar import amplitude_of_lufs, clamp


def sine(t: Column, hz: float, amplitude=1.0) -> Column:
    return amplitude * F.sin(2 * math.pi * hz * t)


def kinds(t: Column, n: Column, low=440, high=1000) -> dict[str, Column]:
    """Signals by name, of time in seconds and sample number; ``low`` and ``high`` are the pitches of their tones, numbers or columns."""
    return {
        "sine": sine(t, low, 0.5),
        "clipped": clamp(sine(t, high, 1.5), -1.0, 1.0),
        "dc": sine(t, high, 0.3) + 0.1,
        "tanh": 0.8 * F.tanh(3 * sine(t, low)) / math.tanh(3),
        "alternating": F.when(n % 2 == 0, 1.0).otherwise(-1.0),
        "silence": F.lit(0.0),
        "lufs": sine(t, high, amplitude_of_lufs(F.lit(-14.0))),
    }


def sampled(rows: DataFrame, samples: int) -> DataFrame:
    """Each row once for each sample, with its number n. Samples are made where the row is; nothing is shuffled."""
    return rows.withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))


def signals_of(rows: DataFrame, rate: int, samples: int) -> DataFrame:
    """(track, kind, n, x) of every kind for each row of (track, low, high)."""
    each = kinds(F.col("n") / rate, F.col("n"), F.col("low"), F.col("high"))
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), x.cast("double").alias("x")) for k, x in each.items()]))
    return sampled(rows, samples).select("track", "n", made.alias("s")).select("track", "s.kind", "n", "s.x")


def sweep(t: Column, span: float, low, high) -> Column:
    """A sine whose pitch rises from ``low`` to ``high``, numbers or columns, evenly in octaves over ``span`` seconds."""
    k = F.log(F.lit(high) / F.lit(low))
    return F.sin(2 * math.pi * F.lit(low) * span / k * (F.exp(t / span * k) - 1))


def pink(n: Column, seed: Column, octaves: int = 16) -> Column:
    """Pink noise from sums of held random values, one octave slower each, from a hash of seed and place: the same each time."""
    digest = lambda k: F.md5(F.concat(seed.cast("string"), F.lit(f":{k}:"), F.shiftright(n, k).cast("string")))
    held = [F.conv(F.substring(digest(k), 1, 13), 16, 10).cast("bigint") / float(1 << 51) - 1 for k in range(octaves)]
    return sum(held[1:], held[0]) / octaves


def signals(spark: SparkSession, rate: int, samples: int) -> DataFrame:
    """(kind, n, x) of every kind."""
    rows = spark.range(samples).withColumnRenamed("id", "n")
    each = F.array(*[F.struct(F.lit(k).alias("kind"), x.cast("double").alias("x")) for k, x in kinds(F.col("n") / rate, F.col("n")).items()])
    return rows.select("n", F.explode(each).alias("s")).select("s.kind", "n", "s.x")


def stereo(spark: SparkSession, kind: str, rate: int, samples: int, right: float = 1.0) -> DataFrame:
    """One stereo track of a kind: (track, n, l, r, mono); the right channel is the left times ``right``."""
    made = spark.range(samples).select(F.lit(kind).alias("track"), F.col("id").alias("n"), kinds(F.col("id") / rate, F.col("id"))[kind].cast("double").alias("l"))
    return made.withColumn("r", F.col("l") * right).withColumn("mono", (F.col("l") + F.col("r")) / 2)


def log_sweep(spark: SparkSession, rate: int, samples: int, low: float = 100.0, high: float = 10_000.0) -> DataFrame:
    """(n, x): a sine whose pitch rises evenly in octaves."""
    return spark.range(samples).select(F.col("id").alias("n"), sweep(F.col("id") / rate, samples / rate, low, high).alias("x"))


def noise(spark: SparkSession, samples: int, seed: int, octaves: int = 16) -> DataFrame:
    """(n, x): pink noise."""
    return spark.range(samples).select(F.col("id").alias("n"), pink(F.col("id"), F.lit(seed), octaves).alias("x"))
