"""From samples to a track's record, and from records to an album's report.

``track_record`` measures (track, n, l, r), one row for each track, under the names that the rules, scores and album operators read. Samples are laid
into blocks and read once: what a record needs of them is a sum, an extreme, a place or a frame of a block (``operators/blocks.py``), and all
metrics are read from these. ``report`` adds issues and warnings, ``album_report`` sums up albums. What was not
measured is null, and a rule over a null doesn't hold.

A track without a whole window has null or empty window metrics; silence has a loudness of minus infinity, which counts as none in the record. Samples
are numbered from 0 without gaps or repeats. An empty table gives no records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ondine.functions.scalar import at_share, clamp, db_from_linear, finite, half_up
from ondine.operators import album, blocks, dynamics, loudness, musical, rules, spectral, stereo
from ondine.operators.filters import band_pass
from ondine.sources import wav
from ondine.staging import staged

#: Levels that silence makes infinite, which count as none.
LIMITED = ("lufs", "tp", "sample_peak", "noise", "balance", "mono_loss", "hf")
#: What only the filtered lows and the spectra tell.
BANDED = {"sub_ok": "boolean", "low_phase": "boolean", "low_width": "double"}
HEARD = {"harsh": "double", "sib": "double", "tilt": "double", "rolloff": "double", "hf": "double", "key_conf": "bigint", "tonal": "bigint"}


def summed(tracks: DataFrame, rate: int) -> DataFrame:
    """What follows from a track's sums, extremes and places alone."""
    n, length = F.col("n"), F.col("n").cast("bigint")
    rms = lambda x: F.sqrt(x / n)
    db = db_from_linear
    mid, side, left, right = rms(F.col("mm")), rms(F.col("side")), rms(F.col("ll")), rms(F.col("rr"))
    ms = lambda x: half_up(x / rate * 1000)
    low, high = F.coalesce(at_share(F.col("strided"), 0.10), F.lit(1e-4)), F.coalesce(at_share(F.col("strided"), 0.95), F.col("mono_top"))
    return tracks.select(
        "track",
        (n / rate).alias("seconds"),
        (F.col("mono") / n).alias("dc"),
        (db(F.col("mono_top")) - db(mid)).alias("crest"),
        ms(F.coalesce("first_loud", length)).alias("silence_start"),
        ms(F.coalesce(length - 1 - F.col("last_loud"), length)).alias("silence_end"),
        F.greatest(F.lit(0.0), db(high) - db(low)).alias("dr"),
        F.col("clip_events").cast("bigint").alias("clip_events"),
        db(F.when(n < 12, F.col("sample_top")).otherwise(F.col("between_top"))).alias("tp"),
        db(F.col("sample_top")).alias("sample_peak"),
        stereo.correlation_of(n, *(F.col(c) for c in ("l", "r", "ll", "rr", "lr"))).alias("corr"),
        F.when((mid > 0) & (side > 0), clamp(side / mid * 100, 0.0, 300.0)).otherwise(0.0).alias("width"),
        F.when((left > 0) & (right > 0), db(right) - db(left)).otherwise(0.0).alias("balance"),
        (db(mid) - db(F.sqrt((F.col("ll") + F.col("rr")) / (2 * n)))).alias("mono_loss"),
        (F.col("differs") / F.least(F.lit(10_000), length) > 1e-4).alias("true_stereo"),
    )


def framed(made: DataFrame, tracks: DataFrame, rate: int) -> list[DataFrame]:
    """What is read from the frames of the samples as they are: contrast, noise, correlation, timing of onsets, tempo."""
    sizes = tracks.select("track", F.col("n").cast("bigint").alias("length"))
    frame = lambda name, *values: blocks.frames_of(made, name, *values)
    window, hop = int(rate * 0.023), rate // 100
    correlated = stereo.windowed_of(frame("corr", "sa", "sb", "saa", "sbb", "sab"), rate // 5)
    onsets = dynamics.onsets(frame("onset", "power").withColumn("energy", F.col("power") / (rate // 100)), rate // 100 // 2, rate)
    envelope = musical.envelope_of(frame("envelope", "power").withColumn("x", F.sqrt(F.col("power") / window)).drop("power"), sizes, window, hop)
    tempi = musical.tempo(envelope)
    return [
        dynamics.contrast(frame("crest", "peak", "power"), rate // 10).select("track", F.col("contrast_db").alias("contrast")),
        dynamics.quietest(frame("noise", "energy"), sizes, 4096).select("track", F.col("noise_floor_db").alias("noise"), "bits"),
        stereo.lowest(correlated, rate // 5).select("track", F.col("worst_1_percent").alias("worst")),
        dynamics.spacing(onsets, sizes, rate // 100 // 2, rate).select("track", "cv", F.col("character").alias("timing")),
        tempi.select("track", F.col("confidence").alias("bpm_conf")),
        musical.beat_stability(envelope, tempi),
    ]


def loudnesses(made: DataFrame, rate: int) -> list[DataFrame]:
    """Gated loudness, its range, trend and volatility."""
    gate = int(rate * 0.4)
    blocks_ = blocks.frames_of(made, "gate", "power").select("track", "frame", (F.col("power") / gate).alias("p"))
    short = loudness.windows_of(blocks.hops_of(made), rate, rate // 10 * 30)
    return [loudness.gated(blocks_).select("track", F.col("gated").alias("lufs")), loudness.loudness_range(short), loudness.slope_and_volatility(short)]


def low_bands(rate: int) -> blocks.Chains:
    """Of what the phase of the sub-bass (20 to 120 Hz) and the width of the lows (20 to 150 Hz) are read."""
    return blocks.low_chains(band_pass(20.0, 120.0, rate), band_pass(20, 150, rate))


def spectral_shares(made: DataFrame, tracks: DataFrame, heard_at: float, frame: int) -> list[DataFrame]:
    """What is read from the sums of the spectra of whole frames, and the key. ``heard_at``: the rate that gives bins their frequencies."""
    average = blocks.spectrum_of(made, heard_at / frame)
    squares = average.withColumn("mag", F.sqrt("square"))
    keys = musical.top_keys(musical.key_scores(musical.chroma(squares, ["track"]), ["track"]), ["track"], most=1)
    return [
        spectral.shares(average, heard_at, frame).select("track", F.col("harshness").alias("harsh"), F.col("sibilance").alias("sib")),
        spectral.tilt(average, heard_at, frame),
        tracks.where("heard > 0").select("track", (F.col("rolloffs") / F.col("heard")).alias("rolloff")),
        spectral.band_level_of(average, 8000, 16000, frame).withColumnRenamed("level_db", "hf"),
        keys.select("track", F.col("confidence").alias("key_conf"), F.col("tonalness").alias("tonal")),
    ]


def measured(signals: DataFrame, rate: int, weigh: bool = True, bands: bool = True, frame: int = 4096, heard_at: float | None = None, block: int = blocks.BLOCK) -> DataFrame:
    """Every per-track metric of the operators, filtered lows (``bands``) too, from one pass over blocks of the samples; K-weighted samples (``weigh``)
    take another one for the loudness. ``frame`` is the size of the spectra (0: none); what is left out is null."""
    heard_at = heard_at or rate
    made = blocks.parts(signals, rate, blocks.record_kinds(rate), frame, heard_at, block, low_bands(rate) if bands else None)
    tracks = staged(blocks.merged(made), "merged")
    loud = blocks.parts(loudness.weighted(signals, rate), rate, {"gate": blocks.record_kinds(rate)["gate"]}, 0, block=block) if weigh else made
    rest = framed(made, tracks, rate) + loudnesses(loud, rate)
    rest += [stereo.lows(tracks)] if bands else []
    rest += spectral_shares(made, tracks, heard_at, frame) if frame else []
    # each part has one row for a track, so they are laid under each other and grouped once
    out = summed(tracks, rate)
    for part in rest:
        out = out.unionByName(part, allowMissingColumns=True)
    out = out.groupBy("track").agg(*[F.first(c, ignorenulls=True).alias(c) for c in out.columns if c != "track"])
    return out.withColumns({c: F.lit(None).cast(t) for c, t in (BANDED | HEARD).items() if c not in out.columns})


def derived(metrics: DataFrame, rate: int | None, bit_depth: int | None, channels: int | None = 2) -> DataFrame:
    """What follows from the metrics: peak to loudness, the margin between samples, clipping; and what the file says, where it is no column yet (None)."""
    own = metrics.withColumns({c: F.when(finite(F.col(c)), F.col(c)) for c in LIMITED})
    own = own.withColumns({"plr": F.col("tp") - F.col("lufs"), "isp": F.col("tp") - F.col("sample_peak"), "clipped": F.col("clip_events") > 0})
    told = {c: F.lit(v) for c, v in (("sample_rate", rate), ("bit_depth", bit_depth), ("channels", channels)) if v is not None}
    return own.withColumns({"ai_score": rules.artifacts(F.col("hf"), F.col("cv"), F.col("timing"))["overall"]} | told)


def track_record(signals: DataFrame, rate: int, bit_depth: int = 24, channels: int = 2) -> DataFrame:
    """The full record of each track: metrics, what follows from them, issues and warnings."""
    return report(derived(measured(signals, rate), rate, bit_depth, channels))


def report(records: DataFrame) -> DataFrame:
    """Adds ``issues`` and ``warnings`` (code, message) and their numbers."""
    flags = rules.gains(F.col("lufs"), F.col("tp"), F.lit(-14.0), F.lit(-1.0))["flags"]
    made = records.withColumns({"issues": rules.issues(), "warnings": rules.warnings(flags)})
    return made.withColumns({"n_issues": F.size("issues").cast("bigint"), "n_warnings": F.size("warnings").cast("bigint")})


def numbered(records: DataFrame, albums: DataFrame) -> DataFrame:
    """Records with their album and track number; ``albums`` has (track, album), and tracks are numbered in their order."""
    return records.join(albums, "track").withColumn("track_number", F.row_number().over(Window.partitionBy("album").orderBy("track")))


def album_report(records: DataFrame) -> DataFrame:
    """Per album: the means, extremes and counts over its numbered records, and how its tracks follow each other in loudness."""
    flow = album.sequence(records).select("album", F.col("spread").alias("loudness_spread"), F.col("jump").alias("worst_jump"), F.col("at").alias("worst_jump_at"), F.col("score").alias("sequence_score"))
    return album.summary(records).join(flow, "album", "left")


def from_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records of the WAV files under a folder, and the reports of their albums (the files' folders), whose tracks are numbered by name.

    Files of one rate are measured together. Broken files and those without samples have no record.
    """
    chunks = wav.read(spark, path).where("error is null")
    told = staged(chunks.groupBy("path").agg(F.first("sample_rate").alias("sample_rate"), F.first("channels").alias("channels"), F.first("bit_depth").alias("bit_depth")), "files")
    records = None
    for rate in sorted(r.sample_rate for r in told.select("sample_rate").distinct().collect()):  # a few
        own = staged(measured(wav.samples(chunks.where(F.col("sample_rate") == rate)), rate), "records")
        records = own if records is None else records.unionByName(own)
    if records is None:
        records = measured(wav.samples(chunks), 44100)
    named = records.join(told.withColumnRenamed("path", "track"), "track")
    named = report(derived(named, None, None, None))
    albums = named.select("track", F.element_at(F.split("track", "/"), -2).alias("album"))
    records = numbered(named, albums)
    return records, album_report(records)
