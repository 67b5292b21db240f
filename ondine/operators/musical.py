"""Tempo and key of tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ondine.functions.scalar import clamp, half_up, pearson, pitch_class, rotated
from ondine.operators.framing import frames

#: Names of the pitch classes and the two key profiles.
NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
#: Frames a second of the onset envelope, and its slowest and fastest tempo.
FRAME_RATE, SLOWEST, FASTEST = 100, 40, 200


def onset_envelope(signals: DataFrame, rate: int) -> DataFrame:
    """Rises of the level in windows of 23 ms at 100 a second, over their largest: (track, i, e). The first frame rises from 0."""
    window, hop = int(rate * 0.023), rate // FRAME_RATE
    made = frames(signals, window, hop, F.sqrt(F.sum(F.col("mono") * F.col("mono")) / window).alias("x"))
    return envelope_of(made, signals.groupBy("track").agg(F.count("*").alias("length")), window, hop)


def envelope_of(made: DataFrame, lengths: DataFrame, window: int, hop: int) -> DataFrame:
    """The same from the level x of frames and the lengths of tracks."""
    made = made.join(lengths, "track").where(F.col("frame") < F.floor((F.col("length") - window) / hop))
    rise = F.greatest(F.lit(0.0), F.col("x") - F.lag("x", 1, 0.0).over(Window.partitionBy("track").orderBy("frame")))
    top = F.max("e").over(Window.partitionBy("track"))
    return made.withColumn("e", rise).select("track", F.col("frame").alias("i"), F.when(top > 0, F.col("e") / top).otherwise(F.col("e")).alias("e"))


#: Frames of an envelope that are correlated at once.
STRETCH = 1 << 14


def _products(low: int, high: int):
    """Sum of the products of the first ``own`` values with those ``lag`` places later, for each lag; null where there are none."""

    @F.pandas_udf("array<double>")
    def sums(values: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for x, n in zip(values, own):
            x = np.asarray(x, np.float64)
            pairs = [min(n, len(x) - lag) for lag in range(low, high + 1)]
            out.append([float(x[:m] @ x[lag : lag + m]) if m > 0 else None for lag, m in zip(range(low, high + 1), pairs)])
        return pd.Series(out)

    return sums


def autocorrelation(envelope: DataFrame, low: int, high: int, stretch: int = STRETCH) -> DataFrame:
    """Mean product of the envelope with itself ``lag`` frames later: (track, lag, r).

    The frames, numbered from 0 without gaps, are laid into stretches of arrays with the next ``high`` frames behind them; each gives its sums
    for all lags, and a track's are added up.
    """
    first = F.greatest(F.floor((F.col("i") - high) / stretch), F.lit(0).cast("bigint"))
    laid = envelope.select("track", "i", "e", F.explode(F.sequence(first, F.floor(F.col("i") / stretch))).alias("block"))
    laid = laid.groupBy("track", "block").agg(F.sort_array(F.collect_list(F.struct("i", "e"))).alias("s"), F.count_if(F.floor(F.col("i") / stretch) == F.col("block")).alias("own"))
    summed = laid.select("track", "own", _products(low, high)(F.transform("s", lambda x: x["e"]), F.col("own")).alias("sums"))
    sizes = summed.groupBy("track").agg(F.sum("own").alias("size"))
    each = summed.select("track", F.posexplode("sums").alias("at", "v")).where("v is not null").groupBy("track", (F.col("at") + low).alias("lag")).agg(F.sum("v").alias("v"))
    return each.join(sizes, "track").select("track", "lag", (F.col("v") / (F.col("size") - F.col("lag"))).alias("r"))


def local_maxima(rows: DataFrame, order: str, value: str, above: float | None = None) -> DataFrame:
    """Rows above both neighbours (and ``above``); the ends have none."""
    w = Window.partitionBy("track").orderBy(order)
    hit = (F.col(value) > F.lag(value).over(w)) & (F.col(value) > F.lead(value).over(w))
    if above is not None:
        hit = hit & (F.col(value) > above)
    return rows.withColumn("__hit", hit).where("__hit").drop("__hit")


def tempo_candidates(envelope: DataFrame) -> DataFrame:
    """Up to five tempi of the strongest correlation peaks, in order: (track, rank, bpm, confidence)."""
    low, high = int(60 / FASTEST * FRAME_RATE), int(60 / SLOWEST * FRAME_RATE)
    peaks = local_maxima(autocorrelation(envelope, low, high), "lag", "r")
    first = peaks.withColumn("p", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("r"), "lag"))).where("p <= 5")
    bpm = 60 * FRAME_RATE / F.col("lag")
    made = first.withColumn("exact", bpm).where(F.col("exact").between(SLOWEST, FASTEST)).select("track", "p", half_up(F.col("exact")).alias("bpm"), half_up(F.col("r") * 100).alias("c"))
    top = F.greatest(F.max("c").over(Window.partitionBy("track")), F.lit(1))
    made = made.withColumn("confidence", half_up(F.col("c") / top * 100))
    return made.select("track", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("confidence"), "p")).alias("rank"), "bpm", "confidence")


def tempo(envelope: DataFrame) -> DataFrame:
    """Primary tempo, its confidence, and whether half or double of it is a candidate too; 120 and 0 for fewer than 100 frames."""
    sizes = envelope.groupBy("track").agg(F.count("*").alias("frames"))
    found = tempo_candidates(envelope).groupBy("track").agg(F.min_by("bpm", "rank").alias("bpm"), F.min_by("confidence", "rank").alias("confidence"), F.collect_list("bpm").alias("all"))
    double = F.exists("all", lambda b: (F.abs(b - F.col("bpm") * 2) < 5) | (F.abs(b - F.col("bpm") / 2) < 3))
    out = sizes.join(found, "track", "left")
    use = F.col("frames") >= 100
    return out.select("track", F.when(use, F.coalesce("bpm", F.lit(120))).otherwise(120).alias("bpm"), F.when(use, F.coalesce("confidence", F.lit(0))).otherwise(0).alias("confidence"), F.when(use, F.coalesce(double, F.lit(False))).otherwise(False).alias("ambiguous"))


def _intervals(envelope: DataFrame, above: float) -> DataFrame:
    peaks = local_maxima(envelope, "i", "e", above)
    return peaks.select("track", (F.col("i") - F.lag("i").over(Window.partitionBy("track").orderBy("i"))).alias("gap"))


def beat_stability(envelope: DataFrame, tempi: DataFrame) -> DataFrame:
    """Score from 0 to 100 of how near the times between onsets are to the beat; 0 for fewer than three onsets."""
    expected = 60 * FRAME_RATE / F.col("bpm")
    made = _intervals(envelope, 0.3).join(tempi, "track").withColumn("d", F.pow((F.col("gap") - expected) / expected, 2))
    per = made.groupBy("track").agg(F.count("*").alias("n"), F.avg("d").alias("v"))
    score = F.when(F.col("n") >= 3, clamp(half_up(100 * (1 - F.sqrt("v"))), 0, 100))
    return tempi.select("track").join(per, "track", "left").select("track", F.coalesce(score, F.lit(0)).alias("stability"))


def tempo_drift(envelope: DataFrame, tempi: DataFrame) -> DataFrame:
    """Deviation of the times between onsets that are within half and double of the beat, in percent of it."""
    expected = 60 * FRAME_RATE / F.col("bpm")
    made = _intervals(envelope, 0.2).join(tempi, "track").withColumn("beat", expected)
    good = (F.col("gap") > F.col("beat") * 0.5) & (F.col("gap") < F.col("beat") * 2)
    per = made.groupBy("track").agg(F.count("*").alias("n"), F.count_if(good).alias("k"), (F.stddev_pop(F.when(good, F.col("gap"))) / F.max("beat") * 100).alias("v"))
    drift = F.coalesce(F.when((F.col("n") >= 4) & (F.col("k") >= 3), F.col("v")), F.lit(0.0))
    out = tempi.select("track").join(per, "track", "left").select("track", drift.alias("drift"))
    return out.withColumn("note", F.when(F.col("drift") > 15, "significant").when(F.col("drift") > 5, "slight"))


def chroma(spectra: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the energy from 65 to 5000 Hz in each pitch class, as an array of 12."""
    some = spectra.where((F.col("k") >= 1) & F.col("freq").between(65, 5000)).withColumn("pc", pitch_class(F.col("freq")))
    sums = [F.sum(F.when(F.col("pc") == i, F.col("mag") * F.col("mag")).otherwise(0.0)) for i in range(12)]
    made = some.groupBy(*keys).agg(F.array(*sums).alias("c"))
    total = F.aggregate("c", F.lit(0.0), lambda s, x: s + x)
    return made.select(*keys, F.when(total > 0, F.transform("c", lambda x: x / total)).otherwise(F.col("c")).alias("chroma"))


def profiles(spark: SparkSession) -> DataFrame:
    """The 24 keys: (ordinal, tonic, key, profile)."""
    rows = [(2 * i + m, i, f"{n} {'Minor' if m else 'Major'}", list(MINOR if m else MAJOR)) for i, n in enumerate(NAMES) for m in (0, 1)]
    return spark.createDataFrame(rows, "ordinal int, tonic int, key string, profile array<double>")


def key_scores(chromas: DataFrame, keys: list[str]) -> DataFrame:
    """Correlation of a chroma with each of the 24 profiles: a cross join with a table of fixed size."""
    both = chromas.crossJoin(F.broadcast(profiles(chromas.sparkSession)))
    return both.select(*keys, "ordinal", "key", pearson(rotated(F.col("chroma"), F.col("tonic")), F.col("profile")).alias("score"))


def top_keys(scores: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """Best keys with their confidence in percent of the scores' range, and the tonalness of the best."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(F.desc("score"), "ordinal"))
    made = scores.withColumns({"rank": rank, "low": F.min("score").over(w), "high": F.max("score").over(w)}).where(F.col("rank") <= most)
    span = F.col("high") - F.col("low")
    confidence = half_up((F.col("score") - F.col("low")) / F.when(span == 0, 1.0).otherwise(span) * 100)
    return made.select(*keys, "rank", "key", confidence.alias("confidence"), clamp(half_up((F.col("high") + 1) * 50), 0, 100).alias("tonalness"))


def key_stability(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """Percent of a track's windows whose best key is the track's; 100 for fewer than two. Both are (track, [window,] key) of rank 1."""
    made = parts.join(whole.select("track", F.col("key").alias("main")), "track").groupBy("track").agg(F.count("*").alias("n"), F.avg((F.col("key") == F.col("main")).cast("double")).alias("share"))
    percent = F.when(F.col("n") < 2, 100).otherwise(half_up(F.col("share") * 100))
    out = made.select("track", percent.cast("bigint").alias("stability"))
    return out.withColumn("note", F.when(F.col("stability") >= 80, "stable").when(F.col("stability") >= 50, "some variation").otherwise("ambiguous"))
