"""Rules, scores and classes of measured tracks, as column expressions over a row of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ondine.functions.scalar import clamp, half_up

#: Fixed values: (platform, target loudness, true-peak limit).
PLATFORMS = (("Spotify", -14.0, -1.0), ("Apple Music", -16.0, -1.0), ("YouTube", -14.0, -1.0), ("Tidal", -14.0, -1.0))


def hits(*rules: tuple[Column, str, Column]) -> Column:
    """Array of (code, message) of the rules that hold, in their order; a condition that is null doesn't hold."""
    each = [F.when(when, F.struct(F.lit(code).alias("code"), message.alias("message"))) for when, code, message in rules]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def _text(pattern: str, *values: Column) -> Column:
    return F.format_string(pattern, *values)


# Bounds and wording of the rules below.
def issues() -> Column:
    """What keeps a track from distribution."""
    c = F.col
    return hits(
        (c("sample_rate") < 44100, "sample_rate", _text("Sample rate %d Hz below 44.1 kHz.", c("sample_rate"))),
        (c("bit_depth") < 16, "bit_depth", _text("Bit depth %d-bit below 16-bit.", c("bit_depth"))),
        (c("tp") > -1.0, "true_peak", _text("True peak %.1f dBTP exceeds -1.0 dBTP (may clip on lossy encoding).", c("tp"))),
        (c("clipped"), "clipping", F.lit("Digital clipping detected.")),
        (c("clip_events") > 10, "clip_events", _text("%d clipping events detected.", c("clip_events"))),
    )


def warnings(spotify_flags: Column) -> Column:
    """What a listener or a platform may mind. ``spotify_flags``: the platform's flags; those that speak of clipping are passed on."""
    c = F.col
    own = hits(
        (c("channels") < 2, "mono", F.lit("Mono file: consider stereo for streaming.")),
        (c("bits") < 14, "effective_bits", _text("Low effective bit depth (~%d-bit): may indicate lossy source or heavy limiting.", c("bits"))),
        (~c("true_stereo") & (c("channels") == 2), "dual_mono", F.lit("Dual mono detected: L and R channels are identical.")),
        (c("lufs") > -9, "loud", _text("Very loud (%.1f LUFS): may cause listener fatigue and heavy attenuation on streaming.", c("lufs"))),
        (c("isp") > 0.5, "isp", _text("High ISP margin (%.2f dB): inter-sample peaks significantly exceed sample peak.", c("isp"))),
        (c("lra") < 3, "lra_low", _text("Low loudness range (%.1f LU): track may sound flat/over-compressed.", c("lra"))),
        (c("lra") > 20, "lra_high", _text("High loudness range (%.1f LU): may need dynamic processing for streaming.", c("lra"))),
        (F.abs(c("dc")) > 0.001, "dc", _text("DC offset detected (%.6f): may cause clicks on playback.", c("dc"))),
        (c("crest") < 6, "crest", _text("Low crest factor (%.1f dB): heavily limited, may lack punch.", c("crest"))),
        (c("plr") < 8, "plr", _text("Low PLR (%.1f dB): track is heavily compressed.", c("plr"))),
        (c("silence_start") > 1000, "silence_start", _text("Long silence at start (%.1fs).", c("silence_start") / 1000)),
        (c("silence_end") > 3000, "silence_end", _text("Long silence at end (%.1fs).", c("silence_end") / 1000)),
        (c("corr") < 0, "correlation", _text("Negative stereo correlation (%.2f): out-of-phase content may cause mono cancellation.", c("corr"))),
        (c("worst") < -0.5, "correlation_worst", _text("Severe phase issues in some sections (worst 1%% correlation: %.2f).", c("worst"))),
        (c("low_phase"), "low_phase", F.lit("Low frequency phase issues detected: may cause bass loss on mono playback.")),
        (~c("sub_ok"), "sub_bass", F.lit("Sub-bass is wide/out-of-phase: may cause translation issues on mono/club systems.")),
        (c("mono_loss") < -3, "mono_loss", _text("Significant mono summing loss (%.1f dB): phase cancellation issues.", c("mono_loss"))),
        (F.abs(c("balance")) > 2, "balance", _text("Unbalanced stereo: %.1f dB %s heavy.", F.abs(c("balance")), F.when(c("balance") > 0, "right").otherwise("left"))),
        (c("low_width") > 50, "low_width", _text("Wide low frequencies (%.0f%% side energy): may cause vinyl cutting or club system issues.", c("low_width"))),
        (c("harsh") > 30, "harshness", _text("High harshness index (%.0f%%): 2-5kHz region is prominent, may cause ear fatigue.", c("harsh"))),
        (c("sib") > 25, "sibilance", _text("High sibilance index (%.0f%%): 5-10kHz region is prominent, may sound harsh.", c("sib"))),
        (c("tilt") > 0, "bright", _text("Bright spectral tilt (+%.1f dB/oct): may sound fatiguing over time.", c("tilt"))),
        (c("tilt") < -6, "dark", _text("Dark spectral tilt (%.1f dB/oct): may lack clarity.", c("tilt"))),
    )
    passed = F.transform(F.filter(spotify_flags, lambda f: F.contains(f, F.lit("clip"))), lambda f: F.struct(F.lit("spotify").alias("code"), F.concat(F.lit("Spotify: "), f).alias("message")))
    return F.concat(own, passed)


def gains(lufs: Column, tp: Column, target: Column, limit: Column) -> Column:
    """Struct of what a platform does to a track: gain, peak after it, flags, and a ceiling to limit to."""
    gain, after = target - lufs, tp + target - lufs
    flags = F.filter(F.array(
        F.when(gain < -1, F.format_string("Attenuated by %.1f dB", F.abs(gain))),
        F.when(after > limit, F.format_string("May clip post-normalization (TP %.1f dBTP > %.0f dBTP)", after, limit)),
        F.when(after > 0, F.lit("Likely to clip or distort")),
    ), lambda x: x.isNotNull())
    return F.struct(gain.alias("gain_db"), after.alias("projected_tp"), flags.alias("flags"), F.when(after > limit, limit - gain).alias("ceiling"))


def simulated(tracks: DataFrame) -> DataFrame:
    """Each track on each platform: a cross join with a table of four rows."""
    table = tracks.sparkSession.createDataFrame(PLATFORMS, "platform string, target double, peak_limit double")
    return tracks.crossJoin(F.broadcast(table)).withColumn("on", gains(F.col("lufs"), F.col("tp"), F.col("target"), F.col("peak_limit")))


def recommendation(lufs: Column) -> Column:
    return F.when(lufs > -10, "very competitive").when(lufs > -14, "competitive").when(lufs > -18, "balanced").otherwise("dynamic")


def gain_class(gain: Column) -> Column:
    return F.when(gain > 0, "positive").when(gain < -6, "severe").otherwise("negative")


def steps(value: Column, *rules: tuple[str, float, float]) -> Column:
    """Loss of the first rule that holds: (">" or "<", bound, loss)."""
    out = None
    for op, bound, loss in rules:
        when = value > bound if op == ">" else value < bound
        out = F.when(when, loss) if out is None else out.when(when, loss)
    return out.otherwise(0.0)


def track_score(n_issues: Column, n_warnings: Column) -> Column:
    c = F.col
    loss = n_issues * 1.5 + n_warnings * 0.3 + F.when(c("ai_score") > 50, 1.0).otherwise(0.0) + F.when(c("clipped"), 0.5).otherwise(0.0) + F.when(c("low_phase"), 0.3).otherwise(0.0) + F.when(c("isp") > 1, 0.2).otherwise(0.0)
    return clamp(10 - loss, 0.0, 10.0)


def section_scores() -> dict[str, Column]:
    """0 to 10 for each section; a metric that is missing counts as a harmless value."""
    c = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    clips = F.when(F.col("clipped"), F.when(c("clip_events", 0) > 100, 3.0).when(c("clip_events", 0) > 10, 2.0).otherwise(1.0)).otherwise(0.0)
    spotify_gain = -14.0 - F.col("lufs")
    loss = {
        "loudness": steps(c("lufs", -14.0), (">", -9, 2.5), (">", -12, 1.0), ("<", -20, 1.5)) + steps(c("lra", 8.0), ("<", 4, 2.0), ("<", 6, 1.0), (">", 18, 0.5)),
        "peaks": steps(c("tp", -3.0), (">", -0.5, 3.0), (">", -1.0, 1.5), (">", -1.5, 0.5)) + steps(c("isp", 0.0), (">", 1.0, 1.5), (">", 0.5, 0.5)),
        "dynamics": clips + steps(c("dr", 12.0), ("<", 6, 2.0), ("<", 10, 1.0)) + steps(c("crest", 10.0), ("<", 6, 1.5), ("<", 8, 0.5)) + steps(c("plr", 12.0), ("<", 8, 1.0)) + steps(F.abs(c("dc", 0.0)), (">", 0.01, 0.5)),
        "stereo": steps(c("corr", 0.8), ("<", 0, 2.5), ("<", 0.3, 1.5), ("<", 0.5, 0.5)) + steps(c("worst", 0.0), ("<", -0.5, 1.5), ("<", 0, 0.5)) + steps(c("mono_loss", 0.0), ("<", -4, 2.0), ("<", -2, 1.0))
        + steps(F.abs(c("balance", 0.0)), (">", 3, 1.5), (">", 1.5, 0.5)) + F.when(F.col("low_phase"), 1.0).otherwise(0.0) + F.when(~F.col("sub_ok"), 0.5).otherwise(0.0),
        "spectral": steps(c("tilt", -3.0), (">", 1, 1.5), (">", 0, 0.5), ("<", -6, 1.0)) + steps(c("harsh", 20.0), (">", 35, 2.0), (">", 28, 1.0)) + steps(c("sib", 15.0), (">", 30, 1.5), (">", 22, 0.5)),
        "streaming": steps(F.col("tp") + spotify_gain, (">", 0, 3.0), (">", -1, 1.5)) + steps(spotify_gain, ("<", -8, 1.5), ("<", -4, 0.5)),
        "musical": steps(c("bpm_conf", 0.0), ("<", 30, 1.5), ("<", 50, 0.5)) + steps(c("key_conf", 0.0), ("<", 30, 1.0), ("<", 50, 0.3)) + steps(c("tonal", 50.0), ("<", 30, 1.0)) + steps(c("stability", 50.0), ("<", 40, 0.5)),
        "artifacts": steps(c("ai_score", 0.0), (">", 70, 3.0), (">", 50, 2.0), (">", 30, 1.0)) + F.when(F.col("hf") > -25, 0.5).otherwise(0.0),
    }
    return {name: clamp(10 - x, 0.0, 10.0) for name, x in loss.items()}


def rating(score: Column) -> Column:
    return F.when(score >= 8.5, "excellent").when(score >= 7.0, "good").when(score >= 5.0, "fair").otherwise("poor")


def artifacts(hf: Column, cv: Column, timing_class: Column) -> Column:
    """Struct of shimmer, timing and the score of both; the score is null where it would be 0. ``timing_class``: the onsets' timing character."""
    shimmer = F.coalesce(hf > -25, F.lit(False))
    shine = F.when(shimmer, F.least(F.lit(100.0), (hf + 25) * 10)).otherwise(0.0)
    robotic = F.coalesce(timing_class == "robotic", F.lit(False))
    timing = F.when(cv.isNotNull(), clamp((1 - cv) * 100, 0.0, 100.0))
    overall = F.least(F.lit(100.0), F.when(shimmer, shine * 0.6).otherwise(0.0) + F.when(robotic & timing.isNotNull(), timing * 0.4).otherwise(0.0))
    return F.struct(shimmer.alias("shimmer"), shine.alias("shimmer_score"), robotic.alias("robotic"), timing.alias("timing_score"), F.when(overall > 0, overall).alias("overall"))


# Bounds, losses and wording.
def codec_quality(rolloff: Column, bits: Column, noise: Column) -> Column:
    """Struct of score, cut-off and note on what a codec may have taken away."""
    loss = F.coalesce(steps(rolloff, ("<", 15000, 40.0), ("<", 17000, 20.0), ("<", 19000, 10.0)), F.lit(0.0))
    loss += F.when(bits <= 12, 25.0).when(bits <= 14, 15.0).when(bits <= 16, 5.0).otherwise(0.0) + steps(noise, (">", -60, 15.0), (">", -70, 5.0))
    score, khz = clamp(100 - loss, 0.0, 100.0), half_up(rolloff / 1000)
    notes = F.filter(F.array(
        F.when(rolloff < 15000, F.format_string("Spectral cutoff at %dkHz indicates lossy compression", khz)).when(rolloff < 17000, F.format_string("Reduced high-frequency content (%dkHz)", khz)),
        F.when(bits <= 12, F.format_string("Low effective bit depth (~%d-bit)", bits)),
        F.when(noise > -60, F.lit("Elevated noise floor")),
    ), lambda x: x.isNotNull())
    note = F.when(F.size(notes) > 0, F.array_join(notes, "; ")).when(score >= 90, "High quality source")
    return F.struct(score.alias("score"), F.when(rolloff < 19000, rolloff).alias("cutoff_hz"), note.alias("note"))


def status(value: Column, *rules: tuple[Column, str]) -> Column:
    out = F.when(value.isNull(), "info")
    for when, name in rules:
        out = out.when(when, name)
    return out.otherwise("good")


def statuses() -> dict[str, Column]:
    c = F.col
    return {
        "lufs_status": status(c("lufs"), ((c("lufs") > -9) | (c("lufs") < -20), "danger"), ((c("lufs") > -11) | (c("lufs") < -18), "warning")),
        "tp_status": status(c("tp"), (c("tp") > -0.5, "danger"), (c("tp") > -1, "warning")),
        "dr_status": status(c("dr"), (c("dr") < 4, "danger"), (c("dr") < 6, "warning")),
        "corr_status": status(c("corr"), (c("corr") < 0, "danger"), (c("corr") < 0.5, "warning")),
        "harsh_status": status(c("harsh"), (c("harsh") > 35, "danger"), (c("harsh") > 28, "warning")),
        "artifact_status": status(c("ai_score"), (c("ai_score") > 50, "danger"), (c("ai_score") > 30, "warning")),
    }


def primary_concern() -> Column:
    """The first concern that holds."""
    c = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    return F.when(F.col("clipped"), "clipping").when(c("tp", -10.0) > -0.5, "true_peak").when(c("corr", 1.0) < 0.3, "correlation").when(c("harsh", 0.0) > 35, "harshness").when(c("lufs", -14.0) > -9, "loudness")


def meter(value: Column, low: float, high: float) -> Column:
    """Place on a meter in percent."""
    return clamp((value - low) / (high - low) * 100, 0.0, 100.0)
