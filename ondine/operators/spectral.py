"""Spectra of frames and what is read from them. Bins are (track, frame, k, freq, mag)."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ondine.functions.scalar import a_weight_db, db_from_linear, half_up

#: The crest bands in Hz.
CREST_BANDS = ((20, 80), (80, 250), (250, 2000), (2000, 5000), (5000, 10000), (10000, 20000))


@functools.lru_cache(maxsize=8)
def _hann(n: int) -> np.ndarray:
    return 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / (n - 1)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def magnitudes(frames: pd.Series) -> pd.Series:
    """Lower half of the magnitude spectrum of Hann-windowed frames of a power of two."""
    return pd.Series([np.abs(np.fft.rfft(np.asarray(x, np.float64) * _hann(len(x))))[: len(x) // 2] for x in frames])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def padded_magnitudes(signals: pd.Series) -> pd.Series:
    """Lower half of the magnitude spectrum of a signal of any length, zero-padded to a power of two, without a window."""
    out = []
    for x in signals:
        n = 1 << max(0, len(x) - 1).bit_length()
        out.append(np.abs(np.fft.rfft(np.asarray(x, np.float64), n))[: n // 2])
    return pd.Series(out)


def bins(frames: DataFrame, rate: float, size: int) -> DataFrame:
    """Of (track, frame, x: array): one row per bin."""
    made = frames.select("track", "frame", F.posexplode(magnitudes("x")).alias("k", "mag"))
    return made.select("track", "frame", "k", (F.col("k") * F.lit(rate / size)).alias("freq"), "mag")


def whole_frames(signals: DataFrame, size: int) -> DataFrame:
    """The mono mix in frames of ``size`` samples that follow each other, without a last one that is not whole: (track, frame, x)."""
    packed = F.transform(F.array_sort(F.collect_list(F.struct("n", "mono"))), lambda s: s["mono"])
    made = signals.groupBy("track", F.floor(F.col("n") / size).alias("frame")).agg(packed.alias("x"))
    return made.where(F.size("x") == size)


def averaged(spectra: DataFrame) -> DataFrame:
    """Mean magnitude of each bin over a track's frames."""
    return spectra.groupBy("track", "k", "freq").agg(F.avg("mag").alias("mag"))


def weighted(average: DataFrame) -> DataFrame:
    """The same with A-weighted magnitudes."""
    return average.withColumn("mag", F.col("mag") * F.pow(F.lit(10.0), a_weight_db(F.col("freq")) / 20))


def rolloff(rows: DataFrame, keys: list[str], share: float = 0.85) -> DataFrame:
    """First frequency up to which ``share`` of the power lies: keys and rolloff. rows: keys, k, freq, p."""
    order, whole = Window.partitionBy(*keys).orderBy("k"), Window.partitionBy(*keys)
    reached = rows.withColumns({"run": F.sum("p").over(order), "total": F.sum("p").over(whole)}).where((F.col("run") >= share * F.col("total")) & (F.col("total") > 0))
    return reached.groupBy(*keys).agg(F.min("freq").alias("rolloff"))


def centroid_rolloff(spectra: DataFrame) -> DataFrame:
    """Means over the frames that have power."""
    rows = spectra.withColumn("p", F.col("mag") * F.col("mag"))
    centroid = rows.groupBy("track", "frame").agg((F.sum(F.col("freq") * F.col("p")) / F.sum("p")).alias("centroid"), F.sum("p").alias("total")).where("total > 0")
    both = centroid.join(rolloff(rows, ["track", "frame"]), ["track", "frame"])
    return both.groupBy("track").agg(F.avg("centroid").alias("centroid"), F.avg("rolloff").alias("rolloff"))


def weighted_centroid_rolloff(average: DataFrame) -> DataFrame:
    rows = weighted(average).where((F.col("k") >= 1) & (F.col("freq") >= 20)).withColumn("p", F.col("mag") * F.col("mag"))
    centroid = rows.groupBy("track").agg((F.sum(F.col("freq") * F.col("p")) / F.sum("p")).alias("centroid_a"))
    return centroid.join(rolloff(rows, ["track"]).withColumnRenamed("rolloff", "rolloff_a"), "track")


def tilt(average: DataFrame, rate: float, size: int, a_weighted: bool = False) -> DataFrame:
    """Slope of the level over the octave, from 100 Hz to the bin of 10 kHz; 0 for fewer than two bins."""
    top = min(size // 2 - 1, int(10000 / (rate / size)))
    some = average.where((F.col("freq") >= 100) & (F.col("k") >= 1) & (F.col("k") <= top) & (F.col("mag") > 0))
    made = (weighted(some) if a_weighted else some).withColumn("y", 20 * F.log10(F.col("mag") + 1e-10))
    return made.groupBy("track").agg(F.when(F.count("*") < 2, 0.0).otherwise(F.regr_slope("y", F.log2("freq"))).alias("tilt"))


def band_level(spectra: DataFrame, low: float, high: float, size: int) -> DataFrame:
    """RMS level in dB of the windowed frames' part from ``low`` to ``high`` Hz: (track, level_db); minus infinity without energy."""
    inside = F.when(F.col("freq").between(low, high), F.col("mag") * F.col("mag")).otherwise(0.0)
    power = 2 * F.sum(inside) / F.countDistinct("frame") / float(size * np.sum(_hann(size) ** 2))
    return spectra.groupBy("track").agg(db_from_linear(F.sqrt(power)).alias("level_db"))


def band_level_of(sums: DataFrame, low: float, high: float, size: int) -> DataFrame:
    """The same from the sum of squares of each bin over the frames: (track, freq, square, frames)."""
    inside = F.when(F.col("freq").between(low, high), F.col("square")).otherwise(0.0)
    power = 2 * F.sum(inside) / F.max("frames") / float(size * np.sum(_hann(size) ** 2))
    return sums.groupBy("track").agg(db_from_linear(F.sqrt(power)).alias("level_db"))


def flatness(average: DataFrame) -> DataFrame:
    """Geometric over arithmetic mean of the bins from 1 on."""
    return average.where((F.col("k") >= 1) & (F.col("mag") > 0)).groupBy("track").agg((F.exp(F.avg(F.log("mag"))) / F.avg("mag")).alias("flatness"))


def shares(average: DataFrame, rate: float, size: int) -> DataFrame:
    """Percent of the energy from 2 to 5 kHz and from 5 to 10 kHz, by bin numbers, and A-weighted by frequencies."""
    res, last = rate / size, size // 2 - 1
    p = F.col("mag") * F.col("mag")
    by_bin = lambda low, high: F.sum(F.when((F.col("k") >= int(low / res)) & (F.col("k") <= min(last, int(high / res))), p).otherwise(0.0))
    by_freq = lambda low, high: F.sum(F.when((F.col("k") >= 1) & F.col("freq").between(low, high), p).otherwise(0.0))
    percent = lambda a, b: F.when(b > 0, a / b * 100).otherwise(0.0)
    raw = average.groupBy("track").agg(percent(by_bin(2000, 5000), by_bin(100, 10000)).alias("harshness"), percent(by_bin(5000, 10000), by_bin(100, 15000)).alias("sibilance"))
    heard = weighted(average).groupBy("track").agg(percent(by_freq(2000, 5000), by_freq(100, 10000)).alias("harshness_a"), percent(by_freq(5000, 10000), by_freq(100, 15000)).alias("sibilance_a"))
    return raw.join(heard, "track")


def band_energy(average: DataFrame, bands: DataFrame) -> DataFrame:
    """Energy and crest of each band: bands is a short table (band, low, high), joined by range."""
    made = average.join(F.broadcast(bands), (F.col("freq") >= F.col("low")) & (F.col("freq") < F.col("high")))
    p = F.col("mag") * F.col("mag")
    return made.groupBy("track", "band").agg(F.sum(p).alias("energy"), (F.max("mag") / F.sqrt(F.avg(p))).alias("crest"))


def balance(tilt_: Column, harshness: Column, centroid: Column) -> Column:
    points = F.when(tilt_ > 0, 2).when(tilt_ > -2, 1).when(tilt_ < -5, -1).otherwise(0)
    points += F.when(harshness > 35, 1).when(harshness < 15, -1).otherwise(0) + F.when(centroid > 4000, 1).when(centroid < 1200, -1).otherwise(0)
    return F.when(points >= 2, "bright").when(points <= -2, "dark").otherwise("balanced")


def distortion(spectra: DataFrame, rate: float, size: int, most: int = 10) -> DataFrame:
    """Harmonic distortion of each frame: fundamental between 50 and 2000 Hz, and the peaks near its harmonics 2 to 5.

    A harmonic's bins are an equi-join with the five numbers around it. Only a track's first ``most`` frames count.
    """
    res, half = rate / size, size // 2
    low, high = -int(-50 // res) if 50 % res else int(50 / res), int(2000 / res)
    some = spectra.where(F.col("frame") < most) if most else spectra
    inside = some.where(F.col("k").between(low, high) & (F.col("mag") > 0))
    base = inside.groupBy("track", "frame").agg(F.min_by("k", F.struct(-F.col("mag"), "k")).alias("f0"), F.max("mag").alias("m0")).where("m0 >= 0.001")
    wanted = base.withColumn("h", F.explode(F.sequence(F.lit(2), F.lit(5)))).withColumn("target", F.col("f0") * F.col("h"))
    near = wanted.where(F.col("target") < half - 1).withColumn("k", F.explode(F.sequence(F.greatest(F.lit(0), F.col("target") - 2), F.least(F.lit(half - 1), F.col("target") + 2))))
    peaks = near.join(some.select("track", "frame", "k", "mag"), ["track", "frame", "k"]).groupBy("track", "frame", "h").agg(F.max("mag").alias("peak"))
    full = wanted.join(peaks, ["track", "frame", "h"], "left").withColumn("peak", F.coalesce("peak", F.lit(0.0)))
    strong = [F.max(F.when(F.col("h") == h, (F.col("peak") > F.col("m0") * 0.01).cast("int"))).alias(f"s{h}") for h in range(2, 6)]
    return full.groupBy("track", "frame", "f0", "m0").agg((F.sqrt(F.sum(F.col("peak") * F.col("peak"))) / F.max("m0") * 100).alias("thd"), *strong)


def distortion_summary(frames: DataFrame, rate: float, size: int) -> DataFrame:
    """Mean distortion, harmonics that are strong in most frames, and the character they give."""
    n = F.count("*")
    dominant = F.filter(F.array(*[F.when(F.sum(f"s{h}") > n * 0.5, F.lit(h)) for h in range(2, 6)]), lambda x: x.isNotNull())
    made = frames.groupBy("track").agg(F.avg("thd").alias("t"), dominant.alias("d"), F.avg(F.col("f0") * (rate / size)).alias("f"))
    even, odd = (F.arrays_overlap("d", F.array(F.lit(a), F.lit(b))) for a, b in ((2, 4), (3, 5)))
    character = F.when(F.col("t") < 0.5, "clean").when(F.col("t") < 2, F.when(even, "warm").otherwise("clean")).when(F.col("t") < 10, F.when(odd, "gritty").otherwise("warm")).otherwise("clipped")
    return made.select("track", (half_up(F.col("t") * 100) / 100).alias("thd_percent"), F.array_join("d", ",").alias("dominant"), character.alias("character"), half_up(F.col("f")).alias("fundamental_hz"))


def asymmetry(left: DataFrame, right: DataFrame) -> DataFrame:
    """Mean centroid of the right spectra minus the left's, over frames where both have one."""
    centroid = lambda s, name: s.where("k >= 1").groupBy("track", "frame").agg((F.sum(F.col("freq") * F.col("mag") * F.col("mag")) / F.sum(F.col("mag") * F.col("mag"))).alias(name))
    both = centroid(left, "a").join(centroid(right, "b"), ["track", "frame"]).where((F.col("a") > 0) & (F.col("b") > 0))
    made = both.groupBy("track").agg((F.avg("b") - F.avg("a")).alias("asymmetry_hz"))
    return made.withColumn("brighter", F.when(F.abs("asymmetry_hz") > 200, F.when(F.col("asymmetry_hz") > 0, "right").otherwise("left")))


def spectrogram(spectra: DataFrame, rate: float, size: int, low: float = -90.0) -> DataFrame:
    """(track, t, k, db) up to 20 kHz, between ``low`` and 0 dB; frames are numbered from 0 in their order."""
    count = min(size // 2, -int(-20000 // (rate / size)))
    order = spectra.select("track", "frame").distinct()
    order = order.withColumn("t", F.row_number().over(Window.partitionBy("track").orderBy("frame")) - 1)
    db = F.when(F.col("mag") > 0, F.greatest(F.lit(low), F.least(F.lit(0.0), 20 * F.log10(F.col("mag") / size)))).otherwise(low)
    return spectra.where(F.col("k") < count).join(order, ["track", "frame"]).select("track", "t", "k", db.alias("db"))


def downsampled(cells: DataFrame, columns: int) -> DataFrame:
    """Mean dB of the frames that fall into each of ``columns`` equal parts; shorter tracks stay as they are."""
    sizes = cells.groupBy("track").agg((F.max("t") + 1).alias("size"))
    ratio = F.col("size") / columns
    guess = F.floor((F.col("t") + 1) / ratio)
    to = F.when(F.col("size") <= columns, F.col("t")).when(F.floor(guess * ratio) <= F.col("t"), guess).otherwise(guess - 1)
    return cells.join(sizes, "track").withColumn("t", to.cast("int")).groupBy("track", "t", "k").agg(F.avg("db").alias("db"))
