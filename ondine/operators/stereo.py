"""Relations of the two channels of tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ondine.functions.scalar import clamp, db_from_linear, finite
from ondine.operators.filters import band_pass, mapped
from ondine.operators.framing import frames, lengths
from ondine.operators.ranks import exact_ranks, worst_percent
from ondine.staging import staged


def correlation_of(n: Column, a: Column, b: Column, aa: Column, bb: Column, ab: Column) -> Column:
    """Pearson's correlation from sums; 0 where a side doesn't vary."""
    va, vb = aa / n - (a / n) * (a / n), bb / n - (b / n) * (b / n)
    return F.when((va > 0) & (vb > 0), (ab / n - (a / n) * (b / n)) / F.sqrt(va * vb)).otherwise(0.0)


def _sums(a: str, b: str) -> list[Column]:
    x, y = F.col(a), F.col(b)
    return [F.sum(x).alias("sa"), F.sum(y).alias("sb"), F.sum(x * x).alias("saa"), F.sum(y * y).alias("sbb"), F.sum(x * y).alias("sab")]


def _correlation(n: Column) -> Column:
    return correlation_of(n, *(F.col(c) for c in ("sa", "sb", "saa", "sbb", "sab")))


def correlation(signals: DataFrame, a: str = "l", b: str = "r") -> DataFrame:
    return signals.groupBy("track").agg(F.count("*").alias("n"), *_sums(a, b)).select("track", _correlation(F.col("n")).alias("correlation"))


def windowed(signals: DataFrame, window: int) -> DataFrame:
    """Correlation of half-overlapped windows: (track, frame, correlation, rms)."""
    return windowed_of(frames(signals, window, window // 2, *_sums("l", "r"), strict=True), window)


def windowed_of(made: DataFrame, window: int) -> DataFrame:
    """The same from the windows' sums sa, sb, saa, sbb and sab."""
    return made.select("track", "frame", _correlation(F.lit(window)).alias("correlation"), F.sqrt((F.col("saa") + F.col("sbb")) / (2 * window)).alias("rms"))


def windowed_stats(signals: DataFrame, window: int, rate: int, worst: int = 5) -> DataFrame:
    """Mean and worst percent of the windows, and the times of the lowest."""
    return lowest(windowed(signals, window), window, worst)


def lowest(made: DataFrame, window: int, worst: int = 5) -> DataFrame:
    """The same from the windows' correlations."""
    made = staged(made.select("track", "frame", "correlation"), "correlation")
    rank = F.row_number().over(Window.partitionBy("track").orderBy("correlation", "frame"))
    low = made.withColumn("rank", rank).where(F.col("rank") <= worst).groupBy("track").agg(F.array_sort(F.collect_list(F.struct("rank", "frame"))).alias("w"))
    out = made.groupBy("track").agg(F.avg("correlation").alias("mean")).join(low, "track").join(exact_ranks(made, ["track"], "correlation", worst_1_percent=worst_percent()), "track")
    return out.select("track", "mean", F.coalesce("worst_1_percent", F.lit(0.0)).alias("worst_1_percent"), F.array_join(F.transform("w", lambda x: x["frame"] * (window // 2)), ",").alias("worst_at"))


def energy_weighted(signals: DataFrame, window: int, least: float = 0.01) -> DataFrame:
    """Correlation weighted by the windows' level; quiet windows are left out."""
    heard = windowed(signals, window).withColumn("w", F.when(F.col("rms") >= least, F.col("rms")))
    made = heard.groupBy("track").agg((F.sum(F.col("correlation") * F.col("w")) / F.sum("w")).alias("correlation"))
    return made.select("track", F.coalesce("correlation", F.lit(0.0)).alias("correlation"))


def _mid_side(a: str, b: str) -> list[Column]:
    mid, side = (F.col(a) + F.col(b)) / 2, (F.col(a) - F.col(b)) / 2
    return [F.sqrt(F.avg(mid * mid)).alias("mid"), F.sqrt(F.avg(side * side)).alias("side")]


def width(signals: DataFrame) -> DataFrame:
    """Level of the side against the middle in percent, up to 300; 0 where either is silent."""
    made = signals.groupBy("track").agg(*_mid_side("l", "r"))
    return made.select("track", F.when((F.col("mid") > 0) & (F.col("side") > 0), clamp(F.col("side") / F.col("mid") * 100, 0.0, 300.0)).otherwise(0.0).alias("width"))


def band_width(signals: DataFrame, rate: int, low: float, high: float) -> DataFrame:
    """The same within a band."""
    kernel = band_pass(low, high, rate)
    made = mapped(signals.select("track", "n", "l", "r"), {"a": ("l", kernel), "b": ("r", kernel)}).groupBy("track").agg(*_mid_side("a", "b"))
    return made.select("track", F.when(F.col("mid") > 0, clamp(F.col("side") / F.col("mid") * 100, 0.0, 300.0)).otherwise(0.0).alias("width"))


def sub_bass(signals: DataFrame, rate: int, low: float = 20.0, high: float = 120.0) -> DataFrame:
    """Correlation of the lowest band, whether it is safe in mono, and whether its phase is wrong."""
    kernel = band_pass(low, high, rate)
    made = correlation(mapped(signals.select("track", "n", "l", "r"), {"a": ("l", kernel), "b": ("r", kernel)}), "a", "b")
    return made.select("track", "correlation", (F.col("correlation") > 0.8).alias("mono_compatible"), (F.col("correlation") < 0.5).alias("phase_issues"))


def lows(tracks: DataFrame) -> DataFrame:
    """Both of these from a track's sums of its filtered lows, ``blocks.LOWS``: (track, sub_ok, low_phase, low_width)."""
    x = correlation_of(F.col("n"), *(F.col(f"sub_{c}") for c in ("l", "r", "ll", "rr", "lr")))
    mid, side = F.sqrt(F.col("low_mm") / F.col("n")), F.sqrt(F.col("low_side") / F.col("n"))
    ratio = F.when(mid > 0, clamp(side / mid * 100, 0.0, 300.0)).otherwise(0.0)
    return tracks.select("track", (x > 0.8).alias("sub_ok"), (x < 0.5).alias("low_phase"), ratio.alias("low_width"))


def balance(signals: DataFrame) -> DataFrame:
    """dB of the right channel over the left; 0 where either is silent."""
    made = signals.groupBy("track").agg(F.sqrt(F.avg(F.col("l") * F.col("l"))).alias("a"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("b"))
    return made.select("track", F.when((F.col("a") > 0) & (F.col("b") > 0), db_from_linear(F.col("b")) - db_from_linear(F.col("a"))).otherwise(0.0).alias("balance_db"))


def _loss(n: Column) -> Column:
    return db_from_linear(F.sqrt(F.col("mm") / n)) - db_from_linear(F.sqrt(F.col("ss") / (2 * n)))


def mono_impact(signals: DataFrame, window: int, worst: int = 5) -> DataFrame:
    """What mixing to mono costs in dB, and where the windows are that lose most."""
    mono = (F.col("l") + F.col("r")) / 2
    sums = [F.sum(mono * mono).alias("mm"), F.sum(F.col("l") * F.col("l") + F.col("r") * F.col("r")).alias("ss")]
    whole = signals.groupBy("track").agg(F.count("*").alias("n"), *sums).select("track", _loss(F.col("n")).alias("loss_db"))
    cut = frames(signals, window, window // 2, *sums, strict=True).select("track", "frame", _loss(F.lit(window)).alias("x")).where(finite(F.col("x")))
    low = cut.withColumn("rank", F.row_number().over(Window.partitionBy("track").orderBy("x", "frame"))).where(F.col("rank") <= worst)
    at = low.groupBy("track").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "frame"))), lambda x: x["frame"] * (window // 2)), ",").alias("worst_at"))
    return whole.join(at, "track", "left").select("track", "loss_db", F.coalesce("worst_at", F.lit("")).alias("worst_at"))


def true_stereo(signals: DataFrame, samples: int = 10_000, least: float = 1e-4) -> DataFrame:
    """Whether the channels differ, by every k-th sample; the sum is divided by the intended number of samples."""
    count = F.least(F.lit(samples), F.col("length"))
    some = signals.join(lengths(signals), "track").where(F.col("n") % F.floor(F.col("length") / count) == 0)
    made = some.groupBy("track").agg((F.sum(F.abs(F.col("l") - F.col("r"))) / F.least(F.lit(samples), F.max("length"))).alias("difference"))
    return made.select("track", "difference", (F.col("difference") > least).alias("true_stereo"))
