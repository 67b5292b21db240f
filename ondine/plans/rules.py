"""Queries of rules, scores and classes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ondine.operators import rules as R
from ondine.plans.dynamics import rounded
from ondine.plans.registry import query
from ondine.plans.tracks import ROBOTIC, SHIMMER, TRK, tracks

ISSUES = {"sample_rate": "sample_rate < 44100", "bit_depth": "bit_depth < 16", "true_peak": "tp > -1", "clipping": "clipped", "clip_events": "clip_events > 10"}
WARNINGS = {
    "mono": "channels < 2", "effective_bits": "bits < 14", "dual_mono": "not true_stereo and channels = 2", "loud": "lufs > -9", "isp": "isp > 0.5e0", "lra_low": "lra < 3", "lra_high": "lra > 20", "dc": "abs(dc) > 0.001e0", "crest": "crest < 6",
    "plr": "plr < 8", "silence_start": "silence_start > 1000", "silence_end": "silence_end > 3000", "correlation": "corr < 0", "correlation_worst": "worst < -0.5e0", "low_phase": "low_phase", "sub_bass": "not sub_ok", "mono_loss": "mono_loss < -3",
    "balance": "abs(balance) > 2", "low_width": "low_width > 50", "harshness": "harsh > 30", "sibilance": "sib > 25", "bright": "tilt > 0", "dark": "tilt < -6", "spotify": "tp - 14 - lufs > -1", "spotify ": "tp - 14 - lufs > 0",
}


def codes_sql(rules: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"case when {w} then '{c.strip()}' end" for c, w in rules.items()) + "], lambda x: x is not null)"


RULED = f"{TRK}, ru as (select *, {codes_sql(ISSUES)} as iss, {codes_sql(WARNINGS)} as war, len({codes_sql(ISSUES)}) as n_issues, len({codes_sql(WARNINGS)}) as n_warnings from tr)"


def ruled(spark, d):
    """Measured tracks with their issues and warnings."""
    made = tracks(spark, d)
    flags = R.gains(F.col("lufs"), F.col("tp"), F.lit(-14.0), F.lit(-1.0))["flags"]
    made = made.withColumns({"issues": R.issues(), "warnings": R.warnings(flags)})
    return made.withColumns({"n_issues": F.size("issues").cast("bigint"), "n_warnings": F.size("warnings").cast("bigint")})


@query(f"with {RULED} select track, array_to_string(iss, ',') as issues, array_to_string(war, ',') as warnings, len(iss) = 0 as ready from ru")
def q_distribution_rules(spark, d):
    codes = lambda c: F.array_join(F.transform(c, lambda x: x["code"]), ",")
    return ruled(spark, d).select("track", codes(F.col("issues")).alias("issues"), codes(F.col("warnings")).alias("warnings"), (F.size("issues") == 0).alias("ready"))


# The wording of the messages, as in operators/rules.py.
MESSAGES = {
    "sample_rate": "printf('Sample rate %d Hz below 44.1 kHz.', sample_rate)",
    "bit_depth": "printf('Bit depth %d-bit below 16-bit.', bit_depth)",
    "true_peak": "printf('True peak %.1f dBTP exceeds -1.0 dBTP (may clip on lossy encoding).', tp)",
    "clipping": "'Digital clipping detected.'",
    "clip_events": "printf('%d clipping events detected.', clip_events)",
    "mono": "'Mono file: consider stereo for streaming.'",
    "effective_bits": "printf('Low effective bit depth (~%d-bit): may indicate lossy source or heavy limiting.', bits)",
    "dual_mono": "'Dual mono detected: L and R channels are identical.'",
    "loud": "printf('Very loud (%.1f LUFS): may cause listener fatigue and heavy attenuation on streaming.', lufs)",
    "isp": "printf('High ISP margin (%.2f dB): inter-sample peaks significantly exceed sample peak.', isp)",
    "lra_low": "printf('Low loudness range (%.1f LU): track may sound flat/over-compressed.', lra)",
    "lra_high": "printf('High loudness range (%.1f LU): may need dynamic processing for streaming.', lra)",
    "dc": "printf('DC offset detected (%.6f): may cause clicks on playback.', dc)",
    "crest": "printf('Low crest factor (%.1f dB): heavily limited, may lack punch.', crest)",
    "plr": "printf('Low PLR (%.1f dB): track is heavily compressed.', plr)",
    "silence_start": "printf('Long silence at start (%.1fs).', silence_start / 1000)",
    "silence_end": "printf('Long silence at end (%.1fs).', silence_end / 1000)",
    "correlation": "printf('Negative stereo correlation (%.2f): out-of-phase content may cause mono cancellation.', corr)",
    "correlation_worst": "printf('Severe phase issues in some sections (worst 1%% correlation: %.2f).', worst)",
    "low_phase": "'Low frequency phase issues detected: may cause bass loss on mono playback.'",
    "sub_bass": "'Sub-bass is wide/out-of-phase: may cause translation issues on mono/club systems.'",
    "mono_loss": "printf('Significant mono summing loss (%.1f dB): phase cancellation issues.', mono_loss::double)",
    "balance": "printf('Unbalanced stereo: %.1f dB %s heavy.', abs(balance), case when balance > 0 then 'right' else 'left' end)",
    "low_width": "printf('Wide low frequencies (%.0f%% side energy): may cause vinyl cutting or club system issues.', low_width)",
    "harshness": "printf('High harshness index (%.0f%%): 2-5kHz region is prominent, may cause ear fatigue.', harsh)",
    "sibilance": "printf('High sibilance index (%.0f%%): 5-10kHz region is prominent, may sound harsh.', sib)",
    "bright": "printf('Bright spectral tilt (+%.1f dB/oct): may sound fatiguing over time.', tilt::double)",
    "dark": "printf('Dark spectral tilt (%.1f dB/oct): may lack clarity.', tilt::double)",
    "spotify": "printf('Spotify: May clip post-normalization (TP %.1f dBTP > -1 dBTP)', tp - 14 - lufs)",
    "spotify ": "'Spotify: Likely to clip or distort'",
}
TOLD = ", ".join(f"case when {w} then {{'code': '{c.strip()}', 'message': {MESSAGES[c]}}} end" for c, w in (ISSUES | WARNINGS).items())


@query(f"with {TRK}, m as (select track, unnest([{TOLD}]) as x from tr) select track, x.code as code, x.message as message from m where x is not null")
def q_rule_messages(spark, d):
    made = ruled(spark, d)
    return made.select("track", F.explode(F.concat("issues", "warnings")).alias("x")).select("track", "x.code", "x.message")


STEPS = {
    "loudness": "case when lufs > -9 then 2.5e0 when lufs > -12 then 1 when lufs < -20 then 1.5e0 else 0 end + case when lra < 4 then 2 when lra < 6 then 1 when lra > 18 then 0.5e0 else 0 end",
    "peaks": "case when tp > -0.5e0 then 3 when tp > -1 then 1.5e0 when tp > -1.5e0 then 0.5e0 else 0 end + case when isp > 1 then 1.5e0 when isp > 0.5e0 then 0.5e0 else 0 end",
    "dynamics": "case when clipped then case when clip_events > 100 then 3 when clip_events > 10 then 2 else 1 end else 0 end + case when dr < 6 then 2 when dr < 10 then 1 else 0 end + case when crest < 6 then 1.5e0 when crest < 8 then 0.5e0 else 0 end + case when plr < 8 then 1 else 0 end + case when abs(dc) > 0.01e0 then 0.5e0 else 0 end",
    "stereo": "case when corr < 0 then 2.5e0 when corr < 0.3e0 then 1.5e0 when corr < 0.5e0 then 0.5e0 else 0 end + case when worst < -0.5e0 then 1.5e0 when worst < 0 then 0.5e0 else 0 end + case when mono_loss < -4 then 2 when mono_loss < -2 then 1 else 0 end + case when abs(balance) > 3 then 1.5e0 when abs(balance) > 1.5e0 then 0.5e0 else 0 end + case when low_phase then 1 else 0 end + case when not sub_ok then 0.5e0 else 0 end",
    "spectral": "case when tilt > 1 then 1.5e0 when tilt > 0 then 0.5e0 when tilt < -6 then 1 else 0 end + case when harsh > 35 then 2 when harsh > 28 then 1 else 0 end + case when sib > 30 then 1.5e0 when sib > 22 then 0.5e0 else 0 end",
    "streaming": "case when tp - 14 - lufs > 0 then 3 when tp - 14 - lufs > -1 then 1.5e0 else 0 end + case when -14 - lufs < -8 then 1.5e0 when -14 - lufs < -4 then 0.5e0 else 0 end",
    "musical": "case when bpm_conf < 30 then 1.5e0 when bpm_conf < 50 then 0.5e0 else 0 end + case when key_conf < 30 then 1 when key_conf < 50 then 0.3e0 else 0 end + case when tonal < 30 then 1 else 0 end + case when stability < 40 then 0.5e0 else 0 end",
    "artifacts": "case when coalesce(ai_score, 0) > 70 then 3 when coalesce(ai_score, 0) > 50 then 2 when coalesce(ai_score, 0) > 30 then 1 else 0 end + case when hf > -25 then 0.5e0 else 0 end",
}
SCORE = "greatest(0, least(10, 10 - len(iss) * 1.5e0 - len(war) * 0.3e0 - case when ai_score > 50 then 1 else 0 end - case when clipped then 0.5e0 else 0 end - case when low_phase then 0.3e0 else 0 end - case when isp > 1 then 0.2e0 else 0 end))"


@query(f"""with {RULED}, sc as (select track, {SCORE} as score, {', '.join(f'greatest(0, 10 - ({x}))::double as {c}' for c, x in STEPS.items())} from ru)
  select track, round(score, 6) as score, case when score >= 8.5 then 'excellent' when score >= 7 then 'good' when score >= 5 then 'fair' else 'poor' end as rating, {', '.join(f'round({c}, 6) as {c}' for c in STEPS)} from sc""")
def q_track_scores(spark, d):
    made = ruled(spark, d).withColumn("score", R.track_score(F.col("n_issues"), F.col("n_warnings")))
    return rounded(made.select("track", "score", R.rating(F.col("score")).alias("rating"), *[x.alias(c) for c, x in R.section_scores().items()]))


@query(f"""with {TRK} select track, case when clipped then 'clipping' when tp > -0.5 then 'true_peak' when corr < 0.3 then 'correlation' when harsh > 35 then 'harshness' when lufs > -9 then 'loudness' end as concern,
  case when lufs > -9 or lufs < -20 then 'danger' when lufs > -11 or lufs < -18 then 'warning' else 'good' end as lufs_status, case when tp > -0.5 then 'danger' when tp > -1 then 'warning' else 'good' end as tp_status,
  case when dr < 4 then 'danger' when dr < 6 then 'warning' else 'good' end as dr_status, case when corr < 0 then 'danger' when corr < 0.5 then 'warning' else 'good' end as corr_status, case when harsh > 35 then 'danger' when harsh > 28 then 'warning' else 'good' end as harsh_status,
  case when ai_score is null then 'info' when ai_score > 50 then 'danger' when ai_score > 30 then 'warning' else 'good' end as artifact_status from tr""")
def q_primary_concern(spark, d):
    return tracks(spark, d).select("track", R.primary_concern().alias("concern"), *[x.alias(c) for c, x in R.statuses().items()])


@query(f"""with {TRK}, p(platform, target, peak_limit) as (values ('Spotify', -14), ('Apple Music', -16), ('YouTube', -14), ('Tidal', -14)) select track, platform, round(target - lufs, 6) as gain_db, round(tp + target - lufs, 6) as projected_tp,
  ((target - lufs < -1)::int + (tp + target - lufs > -1)::int + (tp + target - lufs > 0)::int)::int as n_flags, round(case when tp + target - lufs > -1 then -1 - (target - lufs) end, 6) as ceiling,
  case when target - lufs > 0 then 'positive' when target - lufs < -6 then 'severe' else 'negative' end as gain_class, case when lufs > -10 then 'very competitive' when lufs > -14 then 'competitive' when lufs > -18 then 'balanced' else 'dynamic' end as recommendation from tr, p""".replace("p(platform, target, peak_limit)", "p(platform, target)"))
def q_streaming_sim(spark, d):
    made = R.simulated(tracks(spark, d).select("track", "lufs", "tp"))
    return rounded(made.select("track", "platform", "on.gain_db", "on.projected_tp", F.size("on.flags").alias("n_flags"), "on.ceiling", R.gain_class(F.col("on.gain_db")).alias("gain_class"), R.recommendation(F.col("lufs")).alias("recommendation")))


@query(f"with {TRK} select track, case when lufs + 14 < 0 then 'positive' when -14 - lufs < -6 then 'severe' else 'negative' end as gain_class from tr")
def q_platform_class(spark, d):
    return tracks(spark, d).select("track", R.gain_class(-14.0 - F.col("lufs")).alias("gain_class"))


@query(f"""with {TRK}, q as (select track, rolloff, bits, noise, greatest(0, 100 - case when rolloff < 15000 then 40 when rolloff < 17000 then 20 when rolloff < 19000 then 10 else 0 end - case when bits <= 12 then 25 when bits <= 14 then 15 when bits <= 16 then 5 else 0 end - case when noise > -60 then 15 when noise > -70 then 5 else 0 end)::double as score from tr),
  n as (select *, list_filter([case when rolloff < 15000 then 'Spectral cutoff at ' || (floor(rolloff / 1000 + 0.5)::int) || 'kHz indicates lossy compression' when rolloff < 17000 then 'Reduced high-frequency content (' || (floor(rolloff / 1000 + 0.5)::int) || 'kHz)' end,
    case when bits <= 12 then 'Low effective bit depth (~' || bits || '-bit)' end, case when noise > -60 then 'Elevated noise floor' end], lambda x: x is not null) as notes from q)
  select track, score, case when rolloff < 19000 then rolloff end as cutoff_hz, case when len(notes) > 0 then array_to_string(notes, '; ') when score >= 90 then 'High quality source' end as note from n""")
def q_codec_quality(spark, d):
    return tracks(spark, d).select("track", R.codec_quality(F.col("rolloff"), F.col("bits"), F.col("noise")).alias("q")).select("track", "q.*")


@query(f"""with {TRK} select track, coalesce(hf > -25, false) as shimmer, round({SHIMMER}, 6) as shimmer_score, {ROBOTIC} as robotic,
  round(least(100, greatest(0, (1 - cv) * 100)), 6) as timing_score, round(ai_score, 6) as overall from tr""")
def q_ai_artifacts(spark, d):
    return rounded(tracks(spark, d).select("track", R.artifacts(F.col("hf"), F.col("cv"), F.col("timing")).alias("a")).select("track", "a.*"))


@query(f"with {TRK} select track, round(least(100, greatest(0, (lufs + 30) / 30 * 100)), 6) as lufs_position, round(least(100, greatest(0, (dr - 0) / 20 * 100)), 6) as dr_position from tr")
def q_meter_position(spark, d):
    return rounded(tracks(spark, d).select("track", R.meter(F.col("lufs"), -30, 0).alias("lufs_position"), R.meter(F.col("dr"), 0, 20).alias("dr_position")))
