"""Loudness of tracks: gated blocks, sliding windows, range, changes, and true peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ondine.functions.scalar import INF, db_from_linear, finite, lufs_from_power
from ondine.operators.filters import BANDS, band_pass, k_weighting, mapped
from ondine.operators.framing import frames, hops, sliding_sums
from ondine.operators.ranks import at_share, at_share_capped, exact_ranks
from ondine.staging import staged

#: Mean square of -70 LUFS.
ABSOLUTE_GATE = 10 ** ((-70 + 0.691) / 10)
#: The 4 x 12 interpolation filter of ITU-R BS.1770 (annex 2); phases 2 and 3 mirror 1 and 0.
PHASE_0 = (0.0017089843750, 0.0109863281250, -0.0196533203125, 0.0332031250000, -0.0594482421875, 0.1373291015625, 0.9721679687500, -0.1022949218750, 0.0476074218750, -0.0266113281250, 0.0148925781250, -0.0083007812500)
PHASE_1 = (-0.0291748046875, 0.0292968750000, -0.0517578125000, 0.0891113281250, -0.1665039062500, 0.4650878906250, 0.7797851562500, -0.2003173828125, 0.1015625000000, -0.0582275390625, 0.0330810546875, -0.0189208984375)
PHASES = (PHASE_0, PHASE_1, PHASE_1[::-1], PHASE_0[::-1])


def power(*channels: str) -> Column:
    return sum((F.col(c) * F.col(c) for c in channels[1:]), F.col(channels[0]) * F.col(channels[0]))


def weighted(signals: DataFrame, rate: int) -> DataFrame:
    """K-weights both channels."""
    raw = signals.select("track", "n", F.col("l").alias("l0"), F.col("r").alias("r0"))
    return mapped(raw, {"l": ("l0", k_weighting(rate)), "r": ("r0", k_weighting(rate))}).select("track", "n", "l", "r")


def windows(signals: DataFrame, rate: int, seconds: float) -> DataFrame:
    """Loudness of windows of ``seconds`` at every tenth of a second: (track, i, t, lufs).

    Sums of hops are made once and slid over, so a sample is added up once and not in each of the windows that hold it.
    """
    hop = rate // 10
    window = int(rate * seconds)
    if window % hop:
        made = frames(signals, window, hop, F.sum(power("l", "r")).alias("p"))
        return _windows(made.withColumnRenamed("frame", "i"), window, rate)
    return windows_of(hops(signals, hop, F.sum(power("l", "r")).alias("p")), rate, window)


def windows_of(parts: DataFrame, rate: int, window: int) -> DataFrame:
    """The same from the sums p of hops of a tenth of a second, of which ``window`` is a whole number."""
    hop = rate // 10
    return _windows(sliding_sums(parts, hop, window // hop, "p").withColumnRenamed("hop", "i"), window, rate)


def _windows(sums: DataFrame, window: int, rate: int) -> DataFrame:
    return sums.select("track", "i", (F.col("i") * (rate // 10) / rate).alias("t"), lufs_from_power(F.col("p") / window).alias("lufs"))


def integrated(signals: DataFrame, rate: int) -> DataFrame:
    """Gated and ungated loudness of blocks of 0.4 s that start every 0.3 s."""
    block = int(rate * 0.4)
    return gated(frames(signals, block, int(block * 0.75), (F.sum(power("l", "r")) / block).alias("p")))


def gated(blocks: DataFrame, *more: str) -> DataFrame:
    """Gated and ungated loudness from the mean powers p of blocks, for each track (and each of ``more`` keys)."""
    mean = F.avg(F.when(F.col("p") >= ABSOLUTE_GATE, F.col("p"))).over(Window.partitionBy("track", *more))
    passed = (F.col("p") >= ABSOLUTE_GATE) & (F.col("p") >= F.col("mean") * 0.1)
    made = blocks.withColumn("mean", mean).groupBy("track", *more).agg(F.avg(F.when(passed, F.col("p"))).alias("g"), F.avg("p").alias("u"))
    return made.select("track", *more, F.coalesce(lufs_from_power(F.col("g")), F.lit(-INF)).alias("gated"), lufs_from_power(F.col("u")).alias("ungated"))


def loudness_range(short: DataFrame) -> DataFrame:
    """From the 10th to the 95th percentile of the windows within 20 LU of their mean; 0 for fewer than two."""
    valid = staged(short.where(finite(F.col("lufs")) & (F.col("lufs") > -70)).select("track", "lufs"), "valid")
    means = valid.groupBy("track").agg(F.count("*").alias("n"), F.avg("lufs").alias("mean"))
    near = valid.join(means, "track").where(F.col("lufs") >= F.col("mean") - 20)
    ends = exact_ranks(near, ["track"], "lufs", low=at_share(0.10), high=at_share(0.95))
    made = means.join(ends, "track")
    return made.select("track", F.when(F.col("n") < 2, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("high") - F.col("low"))).alias("lra"))


def percentiles(short: DataFrame, shares: tuple[int, ...] = (10, 50, 90, 95)) -> DataFrame:
    """Percentiles p10, p50, ... of the finite windows; minus infinity where there is none."""
    own = staged(short.select("track", F.when(finite(F.col("lufs")), F.col("lufs")).alias("lufs")), "windows")
    made = exact_ranks(own, ["track"], "lufs", **{f"p{p}": at_share_capped(p / 100) for p in shares})
    return made.select("track", *[F.coalesce(f"p{p}", F.lit(-INF)).alias(f"p{p}") for p in shares])


def slope_and_volatility(short: DataFrame) -> DataFrame:
    """Trend in dB a minute and deviation of the valid windows; 0 for fewer than two."""
    valid = short.where(finite(F.col("lufs")) & (F.col("lufs") > -70))
    made = valid.groupBy("track").agg(F.count("*").alias("n"), (F.regr_slope("lufs", "t") * 60).alias("slope"), F.stddev_pop("lufs").alias("sd"))
    return made.select("track", F.when(F.col("n") < 2, 0.0).otherwise(F.col("slope")).alias("slope_db_per_min"), F.when(F.col("n") < 2, 0.0).otherwise(F.col("sd")).alias("volatility"))


def abrupt_changes(short: DataFrame, lag: int = 20, least: float = 6.0, most: int = 5) -> DataFrame:
    """The ``most`` largest changes over ``lag`` windows above ``least``: (track, rank, t, delta); earlier ones first among equals."""
    before = F.lag("lufs", lag).over(Window.partitionBy("track").orderBy("i"))
    jumps = short.withColumn("before", before).where(finite(F.col("lufs")) & finite(F.col("before")))
    jumps = jumps.withColumn("delta", F.abs(F.col("lufs") - F.col("before"))).where(F.col("delta") > least)
    rank = F.row_number().over(Window.partitionBy("track").orderBy(F.desc("delta"), "i"))
    return jumps.withColumn("rank", rank).where(F.col("rank") <= most).select("track", "rank", "t", "delta")


def extremes(short: DataFrame) -> DataFrame:
    """Times of the loudest and quietest window, the first among equals."""
    return short.where(finite(F.col("lufs"))).groupBy("track").agg(F.min_by("t", F.struct(-F.col("lufs"), "t")).alias("loudest"), F.min_by("t", F.struct("lufs", "t")).alias("quietest"))


def timeline(short: DataFrame, points: int = 200) -> DataFrame:
    """At most ``points`` values that keep the peaks: each of equal buckets gives its least and largest, in their order: (track, k, lufs)."""
    own = short.where(finite(F.col("lufs")))
    size = F.count("*").over(Window.partitionBy("track"))
    place = F.row_number().over(Window.partitionBy("track").orderBy("i")) - 1
    own = own.withColumns({"size": size, "j": place})
    buckets = points // 2
    # bucket i holds the places from floor(i * width) on
    width = F.col("size") / buckets
    guess = F.floor((F.col("j") + 1) / width)
    bucket = F.when(F.floor(guess * width) <= F.col("j"), guess).otherwise(guess - 1)
    dense = own.where(F.col("size") > points).withColumn("b", bucket)
    ends = dense.groupBy("track", "b").agg(F.min_by(F.struct("j", "lufs"), F.struct("lufs", "j")).alias("low"), F.min_by(F.struct("j", "lufs"), F.struct(-F.col("lufs"), "j")).alias("high"))
    pair = F.when(F.col("low.j") <= F.col("high.j"), F.array("low.lufs", "high.lufs")).otherwise(F.array("high.lufs", "low.lufs"))
    made = ends.select("track", "b", F.posexplode(pair).alias("side", "lufs")).select("track", (F.col("b") * 2 + F.col("side")).cast("bigint").alias("k"), "lufs")
    return own.where(F.col("size") <= points).select("track", F.col("j").cast("bigint").alias("k"), "lufs").unionByName(made)


def true_peak(signals: DataFrame, *channels: str, block: int = 1 << 16) -> DataFrame:
    """Largest value of the four-fold interpolated channels in dB; of the samples themselves for fewer than 12.

    A block of a track's samples is filtered by itself; the 11 samples before it come along.
    """
    own = F.floor(F.col("n") / block)
    rows = signals.select("track", "n", *channels).withColumn("block", F.explode(F.when(F.col("n") % block >= block - 11, F.array(own, own + 1)).otherwise(F.array(own))))
    order = Window.partitionBy("track", "block").orderBy("n")
    taps = {c: [F.lag(c, k).over(order) if k else F.col(c) for k in range(12)] for c in channels}
    levels = [F.abs(sum((t[k] * p[k] for k in range(1, 12)), t[0] * p[0])) for t in taps.values() for p in PHASES]
    plain = F.greatest(*[F.abs(c) for c in channels]) if len(channels) > 1 else F.abs(channels[0])
    here = F.col("block") == own
    made = rows.select("track", "n", F.when(here & (F.col("n") >= 11), F.greatest(*levels)).alias("level"), plain.alias("sample"))
    out = made.groupBy("track").agg(F.max("level").alias("peak"), F.max("sample").alias("sample"), F.max("n").alias("last"))
    peak = F.when(F.col("last") < 11, F.col("sample")).otherwise(F.col("peak"))
    return out.select("track", db_from_linear(peak).alias("true_peak_db"), db_from_linear(F.col("sample")).alias("sample_peak_db"))


def peaks_and_loudness(signals: DataFrame, rate: int, size: int = 1 << 16) -> DataFrame:
    """Gated loudness, true and sample peak and the loudest window of three seconds from one pass over blocks of the samples: (track, gated, ungated,
    true_peak_db, sample_peak_db, top). A track without a whole gate block or window has no row."""
    from ondine.operators import blocks

    gate = blocks.record_kinds(rate)["gate"]
    made = blocks.parts(signals.select("track", "n", "l", "r"), rate, {"gate": gate}, 0, block=size)
    loud = gated(blocks.frames_of(made, "gate", "power").select("track", (F.col("power") / gate.window).alias("p")))
    peak = F.when(F.col("n") < 12, F.col("sample_top")).otherwise(F.col("between_top"))
    peaks = made.groupBy("track").agg(F.sum("n").alias("n"), F.max("sample_top").alias("sample_top"), F.max("between_top").alias("between_top"))
    peaks = peaks.select("track", db_from_linear(peak).alias("true_peak_db"), db_from_linear(F.col("sample_top")).alias("sample_peak_db"))
    tops = windows_of(blocks.hops_of(made), rate, rate // 10 * 30).groupBy("track").agg(F.max("lufs").alias("top"))
    return loud.join(peaks, "track").join(tops, "track")


def verified_peak(reported: Column, fallback: Column) -> Column:
    """Struct of a peak and where it is from: the reported one if it is finite and positive."""
    good = finite(reported) & (reported > 0)
    return F.struct(F.when(good, reported).otherwise(fallback).alias("peak"), F.when(good, "ebur128").otherwise("fallback").alias("source"))


def per_band(signals: DataFrame, rate: int, size: int = 1 << 16) -> DataFrame:
    """Gated loudness of each band that lies below the Nyquist frequency: (track, band, lufs); null where there is none.

    The samples are laid into blocks once; each runs through all bands' filters and gives the powers of the gate's blocks that start in it.
    """
    from ondine.operators import blocks

    usable = [(name, low, min(high, rate / 2 * 0.95)) for name, low, high in BANDS if low < min(high, rate / 2 * 0.95)]
    chains = {f"{c}_{name}": (c, band_pass(low, high, rate) + k_weighting(rate)) for name, low, high in usable for c in ("l", "r")}
    gate = blocks.record_kinds(rate)["gate"]
    powers = blocks.banded(signals.select("track", "n", "l", "r"), chains, [name for name, _, _ in usable], gate, size)
    made = gated(powers.select("track", "band", (F.col("power") / gate.window).alias("p")), "band")
    return made.select("track", "band", F.when(finite(F.col("gated")), F.col("gated")).alias("lufs"))


def correction(lufs: Column, target: float = -14.0) -> Column:
    return F.when(finite(lufs), target - lufs).otherwise(0.0)
