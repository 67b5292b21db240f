"""Spectrograms as coloured cells of a picture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ondine.functions.scalar import clamp, half_up


def color_index(db: Column, low: float = -90.0, high: float = 0.0) -> Column:
    return clamp(half_up((db - low) / (high - low) * 255), 0, 255).cast("int")


def colors(index: Column) -> Column:
    """Red, green and blue of an index from 0 to 255: four straight pieces between fixed colours."""
    t = index / 255.0
    piece = lambda start, stops: [half_up(a + (t - start) / 0.25 * b) for a, b in stops]
    # fixed values: start and rise of each channel in each quarter
    quarters = [piece(0.0, ((68, -10), (1, 40), (84, 40))), piece(0.25, ((58, -25), (41, 80), (124, -20))), piece(0.5, ((33, 90), (121, 70), (104, -60))), piece(0.75, ((123, 130), (191, 60), (44, -30)))]
    pick = lambda c: clamp(F.when(t < 0.25, quarters[0][c]).when(t < 0.5, quarters[1][c]).when(t < 0.75, quarters[2][c]).otherwise(quarters[3][c]), 0, 255).cast("int")
    return F.struct(pick(0).alias("r"), pick(1).alias("g"), pick(2).alias("b"))


def row_of_bin(k: Column, bins: int, height: int, log: bool = True) -> Column:
    """Picture row of a bin; logarithmic from the first bin on."""
    if not log:
        return (height - 1 - F.floor(k / bins * height)).cast("int")
    place = F.log10(F.greatest(k, F.lit(1)).cast("double")) / F.log10(F.lit(float(bins)))
    return F.when(k <= 1, height - 1).otherwise(height - 1 - F.floor(place * (height - 1))).cast("int")


def cells(spectrogram: DataFrame, bins: int, width: int, height: int, log: bool = True) -> DataFrame:
    """(track, x, y, color) of (track, t, k, db). Of bins that share a row the highest wins; gaps between rows take the colour below."""
    frames = spectrogram.groupBy("track").agg((F.max("t") + 1).alias("frames"))
    scale = F.lit(float(width)) / F.col("frames")
    x0, x1 = F.floor(F.col("t") * scale), F.least(F.floor((F.col("t") + 1) * scale), F.lit(width)) - 1
    wide = spectrogram.join(frames, "track").withColumns({"x0": x0, "x1": x1, "y": row_of_bin(F.col("k"), bins, height, log)}).where("x1 >= x0")
    one = wide.groupBy("track", "x0", "x1", "y").agg(F.max_by(color_index(F.col("db")), "k").alias("color"))
    above = F.lead("y").over(Window.partitionBy("track", "x0").orderBy(F.desc("y")))
    tall = one.withColumn("to", F.coalesce(above + 1, F.col("y")) if log else F.col("y"))
    return tall.select("track", "color", F.explode(F.sequence("x0", "x1")).alias("x"), "y", "to").select("track", F.col("x").cast("int").alias("x"), F.explode(F.sequence(F.col("to"), F.col("y"))).alias("y"), "color")
