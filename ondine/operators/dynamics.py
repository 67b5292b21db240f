"""Levels, silence, clipping, transients and dynamics of tracks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ondine.functions.scalar import INF, at_share, clamp, db_from_linear, finite, half_up
from ondine.operators import ranks
from ondine.operators.following import BLOCK, first_at_or_below, first_below, laid
from ondine.operators.framing import frames, lengths
from ondine.staging import staged

CLIPPED, SILENT, HIGH = 0.9999, 0.001, 0.95


def basic_stats(signals: DataFrame) -> DataFrame:
    """Mean (DC), RMS, peak and crest factor of the mono mix."""
    made = signals.groupBy("track").agg(F.avg("mono").alias("dc"), F.sqrt(F.avg(F.col("mono") * F.col("mono"))).alias("rms"), F.max(F.abs("mono")).alias("peak"))
    return made.withColumns({"peak_db": db_from_linear(F.col("peak")), "rms_db": db_from_linear(F.col("rms"))}).withColumn("crest_db", F.col("peak_db") - F.col("rms_db"))


def silence_edges(signals: DataFrame, rate: int, threshold: float = SILENT) -> DataFrame:
    """Milliseconds of silence at both ends; a silent track is silent from both."""
    loud = F.greatest(F.abs("l"), F.abs("r")) > threshold
    ends = signals.groupBy("track").agg(F.min(F.when(loud, F.col("n"))).alias("a"), F.max(F.when(loud, F.col("n"))).alias("b"), F.count("*").alias("length"))
    ms = lambda x: half_up(x / rate * 1000)
    return ends.select("track", ms(F.coalesce("a", "length")).alias("start_ms"), ms(F.coalesce(F.col("length") - 1 - F.col("b"), F.col("length"))).alias("end_ms"))


def dynamic_range(signals: DataFrame, samples: int = 10_000) -> DataFrame:
    """dB from the 10th to the 95th percentile of every k-th sample above 1e-4; without such, from 1e-4 to the peak."""
    step = F.greatest(F.lit(1), F.floor(F.col("length") / samples))
    some = signals.join(lengths(signals), "track").withColumn("a", F.abs("mono"))
    kept = F.collect_list(F.when((F.col("n") % step == 0) & (F.col("a") > 1e-4), F.col("a")))
    made = some.groupBy("track").agg(kept.alias("v"), F.max("a").alias("peak"))
    low, high = F.coalesce(at_share(F.col("v"), 0.10), F.lit(1e-4)), F.coalesce(at_share(F.col("v"), 0.95), F.col("peak"))
    return made.select("track", F.greatest(F.lit(0.0), db_from_linear(high) - db_from_linear(low)).alias("dynamic_range_db"))


def clip_runs(signals: DataFrame, threshold: float = CLIPPED) -> DataFrame:
    """Runs of clipped samples of both channels, laid under each other: (track, channel, start, duration)."""
    channel = lambda c, k: signals.select("track", "n", F.lit(k).alias("channel"), F.col(c).alias("x"))
    hit = channel("l", 0).unionByName(channel("r", 1)).where(F.abs("x") >= threshold)
    island = F.col("n") - F.row_number().over(Window.partitionBy("track", "channel").orderBy("n"))
    return hit.withColumn("island", island).groupBy("track", "channel", "island").agg(F.min("n").alias("start"), F.count("*").alias("duration")).drop("island")


def clip_events(signals: DataFrame, rate: int) -> DataFrame:
    """Clipped samples, events, their number a minute, and the starts of the five longest (channel and time break ties)."""
    runs = clip_runs(signals)
    rank = F.row_number().over(Window.partitionBy("track").orderBy(F.desc("duration"), "channel", "start"))
    runs = runs.withColumn("rank", rank)
    worst = F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "start"))))
    made = runs.groupBy("track").agg(F.sum("duration").alias("clipped"), F.count("*").alias("events"), F.transform(worst, lambda x: x["start"]).alias("worst"))
    out = lengths(signals).join(made, "track", "left")
    return out.select("track", F.coalesce("clipped", F.lit(0)).alias("clipped"), F.coalesce("events", F.lit(0)).alias("events"), (F.coalesce("events", F.lit(0)) / (F.col("length") / rate / 60)).alias("per_minute"), F.coalesce(F.array_join("worst", ","), F.lit("")).alias("worst"))


def peak_clusters(signals: DataFrame, window: int, threshold: float = HIGH) -> DataFrame:
    """How many runs of windows with high peaks there are, and of what kind."""
    peaks = frames(signals, window, window // 2, F.max(F.greatest(F.abs("l"), F.abs("r"))).alias("peak"), strict=True)
    high = F.col("peak") >= threshold
    before = F.lag(high, 1, False).over(Window.partitionBy("track").orderBy("frame"))
    made = peaks.withColumn("rise", high & ~before).groupBy("track").agg(F.count_if("rise").alias("clusters"), F.avg(high.cast("double")).alias("ratio"))
    kind = F.when(F.col("ratio") > 0.3, "persistent").when((F.col("ratio") < 0.05) & (F.col("clusters") < 10), "sporadic").otherwise("mixed")
    return made.withColumn("kind", kind)


def upper_median(rows: DataFrame, value: str, name: str) -> DataFrame:
    """(track, name): sorted[floor(n / 2)] of the values that are not null, 0 without any."""
    made = ranks.exact_ranks(rows, ["track"], value, median=ranks.at_share(0.5))
    return made.select("track", F.coalesce("median", F.lit(0.0)).alias(name))


def micro_contrast(signals: DataFrame, window: int) -> DataFrame:
    """Upper median of the windows' crest factors in dB."""
    return contrast(frames(signals, window, window // 2, F.max(F.abs("mono")).alias("peak"), F.sum(F.col("mono") * F.col("mono")).alias("power"), strict=True), window)


def contrast(made: DataFrame, window: int) -> DataFrame:
    """The same from the windows' peak and power."""
    rms = F.sqrt(F.col("power") / window)
    crest = db_from_linear(F.col("peak")) - db_from_linear(rms)
    good = (rms > 1e-4) & (F.col("peak") > 0) & finite(crest) & (crest > 0)
    return upper_median(staged(made.select("track", F.when(good, crest).alias("crest")), "crests"), "crest", "contrast_db")


def envelope(signals: DataFrame, window: int) -> DataFrame:
    """RMS in dB of half-overlapped windows: (track, frame, level); -100 where it is very quiet."""
    made = frames(signals, window, window // 2, F.sum(F.col("mono") * F.col("mono")).alias("power"), strict=True)
    rms = F.sqrt(F.col("power") / window)
    return made.select("track", "frame", F.when(rms > 1e-4, db_from_linear(rms)).otherwise(-100.0).alias("level"))


def attack_speed(signals: DataFrame, window: int, rate: int) -> DataFrame:
    """Upper median of the envelope's rises, in dB a millisecond."""
    hop_ms = window // 2 / rate * 1000
    slope = (F.col("level") - F.lag("level").over(Window.partitionBy("track").orderBy("frame"))) / hop_ms
    rises = envelope(signals, window).withColumn("slope", slope).select("track", F.when(F.col("slope") > 0.1, F.col("slope")).alias("slope"))
    return upper_median(staged(rises, "rises"), "slope", "attack_index")


def release_tail(signals: DataFrame, window: int, rate: int) -> DataFrame:
    """Upper median of the time from an envelope's local maxima to the first level 10 dB lower, of times below two seconds."""
    hop_ms = window // 2 / rate * 1000
    levels = staged(envelope(signals, window), "envelope")
    order = Window.partitionBy("track").orderBy("frame")
    around = levels.withColumns({"before": F.lag("level").over(order), "after": F.lead("level").over(order)})
    peaks = around.where((F.col("level") > F.col("before")) & (F.col("level") > F.col("after")) & (F.col("level") > -40))
    found = first_at_or_below(levels.select("track", F.col("frame").alias("n"), F.col("level").alias("x")), peaks.select("track", F.col("frame").alias("at"), (F.col("level") - 10).alias("level")))
    ms = found.select("track", ((F.col("found") - F.col("at")) * hop_ms).alias("ms")).where("ms < 2000")
    tails = upper_median(staged(ms, "tails"), "ms", "tail_ms")
    return levels.select("track").distinct().join(tails, "track", "left").select("track", F.coalesce("tail_ms", F.lit(0.0)).alias("tail_ms"))


def _spaced(gap: int):
    """Of ascending places: the first, and each that is at least ``gap`` after the last one taken."""

    @F.pandas_udf("array<bigint>")
    def pick(runs: pd.Series) -> pd.Series:
        out = []
        for run in runs:
            taken = []
            for i in run:
                if not taken or i - taken[-1] >= gap:
                    taken.append(i)
            out.append(taken)
        return pd.Series(out)

    return pick


def transients(signals: DataFrame, window: int, rate: int) -> DataFrame:
    """Onsets: (track, i) of the energy rises above mean plus two deviations, at least 50 ms after the last accepted one.

    Which rise is accepted depends on the one accepted before. A candidate that comes 50 ms or more after the candidate before it
    is accepted in any case, so it opens a run that is decided by itself.
    """
    hop = window // 2
    return onsets(frames(signals, window, hop, (F.sum(F.col("mono") * F.col("mono")) / window).alias("energy"), strict=True), hop, rate)


def onsets(energy: DataFrame, hop: int, rate: int) -> DataFrame:
    """The same from the energy of windows."""
    order, whole = Window.partitionBy("track").orderBy("frame"), Window.partitionBy("track")
    rise = F.greatest(F.lit(0.0), F.col("energy") - F.lag("energy").over(order))
    rises = energy.withColumn("rise", rise).where("frame > 0").withColumn("i", F.col("frame") - 1)
    above = F.col("rise") > F.avg("rise").over(whole) + 2 * F.stddev_pop("rise").over(whole)
    gap = int(rate * 0.05 / hop)
    by_place = Window.partitionBy("track").orderBy("i")
    opens = F.coalesce(F.col("i") - F.lag("i").over(by_place) >= gap, F.lit(True))
    found = rises.withColumn("above", above).where("above").withColumn("opens", opens.cast("bigint"))
    runs = found.withColumn("run", F.sum("opens").over(by_place)).groupBy("track", "run").agg(F.array_sort(F.collect_list("i")).alias("c"))
    return runs.select("track", F.explode(_spaced(gap)("c")).alias("i"))


# Bounds and names of the characters.
def timing_character(cv: Column) -> Column:
    return F.when(cv < 0.08, "robotic").when(cv < 0.18, "tight").when(cv < 0.40, "natural").otherwise("loose")


def variation(values: Column) -> Column:
    """Population deviation over the mean of an array, by Welford's running update in its order; null for nothing."""

    def step(s: Column, x: Column) -> Column:
        mean = s["mean"] + (x - s["mean"]) / (s["n"] + 1)
        return F.struct((s["n"] + 1).alias("n"), mean.alias("mean"), (s["m2"] + (x - mean) * (x - s["mean"])).alias("m2"), (s["total"] + x).alias("total"))

    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mean", "m2", "total")])
    return F.aggregate(values, zero, step, lambda s: F.try_divide(F.sqrt(F.try_divide(s["m2"], s["n"])), F.try_divide(s["total"], s["n"])))


def transient_spacing(signals: DataFrame, window: int, rate: int) -> DataFrame:
    """Onsets, their number a minute, and the variation of the time between them."""
    return spacing(transients(signals, window, rate), lengths(signals), window // 2, rate)


def spacing(found: DataFrame, sizes: DataFrame, hop: int, rate: int) -> DataFrame:
    """The same from the onsets and the lengths of tracks."""
    gap = F.col("i") - F.lag("i").over(Window.partitionBy("track").orderBy("i"))
    gaps = found.withColumn("gap", gap * hop / rate)
    # a cv may lie on a bound of the characters, where the last bit decides: gaps are taken in order, whatever the partitions
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("gap").isNotNull(), F.struct("i", "gap")))), lambda x: x["gap"])
    made = gaps.groupBy("track").agg(F.count("*").alias("onsets"), variation(ordered).alias("cv"))
    cv = F.when(F.col("onsets") >= 3, F.col("cv")).otherwise(0.0)
    out = sizes.join(made, "track", "left").withColumns({"onsets": F.coalesce("onsets", F.lit(0)), "cv": F.coalesce(cv, F.lit(0.0))})
    return out.select("track", "onsets", (F.col("onsets") / (F.col("length") / rate / 60)).alias("per_minute"), "cv", F.when(F.col("onsets") < 3, "natural").otherwise(timing_character(F.col("cv"))).alias("character"))


def _around(window: int, quarter: int):
    """Of arrays of samples and of places in them: power before and after each place, the peak of a window from it, and how far from the place the first
    sample of the nine windows after that lies which is at or below 0.316 of the peak (-1: none)."""

    @F.pandas_udf("array<struct<pre: double, post: double, peak: double, decay: bigint>>")
    def measure(samples: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for x, at in zip(samples, places):
            x, at = np.asarray(x, np.float64), np.asarray(at, np.int64)
            level = np.abs(x)
            part = lambda low, high, at=at: at[:, None] + np.arange(low, high)
            pre, post = (np.sqrt((x[part(low, low + quarter)] ** 2).sum(1) / quarter) for low in (-quarter, 0))
            peak = level[part(0, window)].max(1)
            decay = first_below(level, at + window - 1, peak * 0.316) - at
            decay = np.where((decay >= window) & (decay < window * 10), decay, -1)
            out.append([{"pre": a, "post": b, "peak": c, "decay": d} for a, b, c, d in zip(pre.tolist(), post.tolist(), peak.tolist(), decay.tolist())])
        return pd.Series(out)

    return measure


def transient_sharpness(signals: DataFrame, window: int, rate: int, onset_window: int, block: int = BLOCK) -> DataFrame:
    """Attack slopes and decay times around the onsets, scored. Samples are laid into blocks once, and a block is measured around all of its onsets."""
    hop, quarter = onset_window // 2, window // 4
    places = staged(transients(signals, onset_window, rate), "onsets")
    onsets = places.withColumn("at", F.col("i") * hop)
    total = onsets.groupBy("track").agg(F.count("*").alias("onsets"))
    sizes = staged(lengths(signals), "lengths")
    inside = onsets.join(sizes, "track").where((F.col("at") >= window) & (F.col("at") + window < F.col("length")))
    # a block holds the onsets whose first quarter starts in it
    start = F.col("at") - quarter
    asked = inside.groupBy("track", F.floor(start / block).alias("block")).agg(F.collect_list(start % block + quarter).alias("places"))
    arrays = laid(signals.select("track", "n", F.col("mono").alias("x")), block, quarter + window * 10)
    per = asked.join(arrays, ["track", "block"]).select("track", F.explode(_around(window, quarter)("x", "places")).alias("m")).select("track", "m.*")
    slope = (db_from_linear(F.col("post")) - db_from_linear(F.col("pre"))) / (quarter / rate * 1000)
    slope = F.when((F.col("pre") > 1e-4) & (F.col("post") > 1e-4) & (slope > 0.1), slope)
    ms = F.when(F.col("decay") >= 0, F.col("decay") / rate * 1000)
    ms = F.when((F.col("peak") > 0.01) & (ms > 1) & (ms < 500), ms)
    around = staged(per.select("track", slope.alias("slope"), ms.alias("ms")), "around")
    median = lambda c: ranks.exact_ranks(around.select("track", c), ["track"], c, **{f"{c}_median": ranks.at_share(0.5)}).drop("size")
    made = median("slope").join(median("ms"), "track")
    out = spacing(places, sizes, hop, rate).select("track", "cv").join(total, "track", "left").join(made, "track", "left")
    enough = F.coalesce("onsets", F.lit(0)) >= 2
    mid, decay = F.col("slope_median"), F.col("ms_median")
    return out.select(
        "track",
        F.when(enough, half_up(F.when(mid.isNull(), 50.0).otherwise(clamp(mid * 50, 0.0, 100.0)))).otherwise(50).alias("steepness"),
        F.when(enough, half_up(clamp((1 - F.col("cv") * 2) * 100, 0.0, 100.0))).otherwise(100).alias("uniformity"),
        F.when(enough & mid.isNotNull(), half_up(10 / F.greatest(mid, F.lit(0.1)) * 10) / 10).alias("attack_ms"),
        F.when(enough, half_up(decay)).alias("decay_ms"),
    )


# Bounds, ratios, thresholds and weights of the two below, and the wording of the note.
def compression(crest: Column, dr: Column, clips_per_minute: Column) -> Column:
    """Struct of character, ratio, threshold and confidence."""
    pick = lambda character, ratio, threshold, confidence: F.struct(F.lit(character).alias("character"), ratio.cast("double").alias("ratio"), F.lit(threshold).cast("double").alias("threshold_db"), confidence.alias("confidence"))
    low, medium, high = F.lit("low"), F.lit("medium"), F.lit("high")
    floor = F.greatest(crest, F.lit(1.0))
    return (
        F.when((crest < 5) & (dr < 5), pick("brickwall", F.lit(20), -1, F.when(clips_per_minute > 10, high).otherwise(medium)))
        .when((crest < 7) & (dr < 8), pick("heavy", half_up(20 / floor), -6, medium))
        .when((crest < 10) & (dr < 12), pick("moderate", half_up(15 / floor), -12, F.when(crest < 8, medium).otherwise(low)))
        .when(crest < 14, pick("light", F.lit(2), -18, low))
        .otherwise(pick(None, F.lit(None), None, low))
    )


def preservation(crest: Column, dr: Column, clipped: Column, contrast: Column) -> Column:
    """Score from 0 to 100 of how well dynamics are kept."""
    loss = F.when(crest < 6, (6 - crest) * 8).when(crest < 10, (10 - crest) * 3).otherwise(0.0)
    loss += F.when(dr < 6, (6 - dr) * 6).when(dr < 10, (10 - dr) * 2).otherwise(0.0)
    loss += F.when(contrast < 4, (4 - contrast) * 5).otherwise(0.0) + F.when(clipped, 15.0).otherwise(0.0)
    return clamp(100 - loss, 0.0, 100.0)


def preservation_note(score: Column) -> Column:
    return F.when(score >= 85, "Excellent dynamic preservation").when(score >= 70, "Good dynamics, moderate processing").when(score >= 50, "Compressed, reduced dynamics").otherwise("Heavily compressed/limited")


def noise_floor(signals: DataFrame, window: int = 4096) -> DataFrame:
    """Quietest window that is not silent, and the bits that it leaves; infinite and 8 without one."""
    return quietest(frames(signals, window, window, F.sum(F.col("mono") * F.col("mono")).alias("energy"), strict=True), lengths(signals), window)


def quietest(made: DataFrame, sizes: DataFrame, window: int) -> DataFrame:
    """The same from the windows' energy and the lengths of tracks."""
    quiet = made.where("energy > 0").groupBy("track").agg(F.min("energy").alias("energy"))
    out = sizes.join(quiet, "track", "left")
    db = F.coalesce(10 * F.log10(F.col("energy") / window), F.lit(INF))
    return out.select("track", db.alias("noise_floor_db"), F.when(db == INF, 8).otherwise(clamp(half_up((-db - 6) / 6), 8, 24)).cast("int").alias("bits"))
