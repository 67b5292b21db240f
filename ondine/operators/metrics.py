"""A catalog of what is measured of a track, and measured tracks read by it."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ondine.functions.scalar import finite


class Metric(NamedTuple):
    """``low`` and ``high`` bound what a listener won't mind; None where a side has no bound."""

    metric: str
    name: str
    category: str
    unit: str
    description: str
    low: float | None = None
    high: float | None = None


#: Columns of a track's record, in the order of a report.
METRICS = (
    Metric("lufs", "Integrated loudness", "loudness", "LUFS", "Mean loudness of the blocks above both gates", -20.0, -9.0),
    Metric("lra", "Loudness range", "loudness", "LU", "Distance between quiet and loud stretches of three seconds", 3.0, 20.0),
    Metric("slope_db_per_min", "Loudness trend", "loudness", "dB/min", "How loudness rises or falls along the track"),
    Metric("volatility", "Loudness volatility", "loudness", "LU", "Deviation of short-term loudness"),
    Metric("tp", "True peak", "peaks", "dBTP", "Largest level between and on the samples", None, -1.0),
    Metric("sample_peak", "Sample peak", "peaks", "dBFS", "Largest sample", None, 0.0),
    Metric("isp", "Inter-sample margin", "peaks", "dB", "True peak above the sample peak", None, 0.5),
    Metric("clip_events", "Clipping", "peaks", "events", "Runs of samples at full scale", None, 0.0),
    Metric("dr", "Dynamic range", "dynamics", "dB", "From quiet samples to loud ones", 6.0, None),
    Metric("crest", "Crest factor", "dynamics", "dB", "Peak above the root mean square", 6.0, None),
    Metric("plr", "Peak to loudness", "dynamics", "dB", "True peak above integrated loudness", 8.0, None),
    Metric("contrast", "Micro-contrast", "dynamics", "dB", "Median crest factor of short windows", 4.0, None),
    Metric("dc", "Offset", "dynamics", "linear", "Mean of the samples", -0.001, 0.001),
    Metric("noise", "Noise floor", "dynamics", "dB", "Level of the quietest window", None, -60.0),
    Metric("corr", "Correlation", "stereo", "-1..1", "How alike both channels are", 0.0, None),
    Metric("worst", "Worst correlation", "stereo", "-1..1", "Correlation of the worst hundredth of the windows", -0.5, None),
    Metric("width", "Width", "stereo", "%", "Side level against mid level"),
    Metric("balance", "Balance", "stereo", "dB", "Right level above the left one", -2.0, 2.0),
    Metric("mono_loss", "Mono loss", "stereo", "dB", "What summing to mono takes away", -3.0, None),
    Metric("tilt", "Spectral tilt", "spectrum", "dB/oct", "Slope of the mean spectrum", -6.0, 0.0),
    Metric("harsh", "Harshness", "spectrum", "%", "Share of the upper mids", None, 30.0),
    Metric("sib", "Sibilance", "spectrum", "%", "Share of the band of hissing sounds", None, 25.0),
    Metric("rolloff", "Rolloff", "spectrum", "Hz", "Frequency below which most of the power lies", 15000.0, None),
    Metric("bpm_conf", "Tempo confidence", "musical", "%", "How sure the tempo is", 30.0, None),
    Metric("key_conf", "Key confidence", "musical", "%", "How sure the key is", 30.0, None),
    Metric("ai_score", "Artifacts", "artifacts", "0..100", "Shimmer and machine-like timing", None, 30.0),
)
SCHEMA = "ordinal int, metric string, name string, category string, unit string, description string, low double, high double"


def catalog(spark: SparkSession) -> DataFrame:
    """(ordinal, metric, name, category, unit, description, low, high)."""
    return spark.createDataFrame([(i, *m) for i, m in enumerate(METRICS)], SCHEMA)


def values(records: DataFrame) -> DataFrame:
    """(track, metric, value) of the metrics that the records have as columns; null where one is not finite."""
    own = [m.metric for m in METRICS if m.metric in records.columns]
    number = lambda c: F.col(c).cast("double")
    wide = records.select("track", *[F.when(finite(number(c)), number(c)).alias(c) for c in own])
    return wide.unpivot("track", own, "metric", "value")


def place() -> Column:
    """Where a value lies against its metric's bounds."""
    v = F.col("value")
    return F.when(v.isNull(), "missing").when(v < F.col("low"), "low").when(v > F.col("high"), "high").when(F.col("low").isNull() & F.col("high").isNull(), "unrated").otherwise("good")


def placed(records: DataFrame) -> DataFrame:
    """Every metric of every track with its catalog entry and ``status``; the catalog has a fixed size and is broadcast."""
    return values(records).join(F.broadcast(catalog(records.sparkSession)), "metric").withColumn("status", place())


def overview(records: DataFrame) -> DataFrame:
    """Every metric of the catalog, those without a value too: how many tracks have it, its least, mean and largest value, and how many are good, low and high."""
    made = values(records).join(F.broadcast(catalog(records.sparkSession)), "metric").withColumn("status", place())
    counted = made.groupBy("metric").agg(F.count("value").alias("tracks"), F.min("value").alias("least"), F.avg("value").alias("mean"), F.max("value").alias("most"), *[F.count_if(F.col("status") == s).alias(s) for s in ("good", "low", "high")])
    none = [F.coalesce(c, F.lit(0)).alias(c) for c in ("tracks", "good", "low", "high")]
    return catalog(records.sparkSession).drop("low", "high").join(counted, "metric", "left").select("ordinal", "metric", "category", "unit", "least", "mean", "most", *none)
