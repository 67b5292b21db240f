"""Measured tracks for the queries of rules, scores and albums.

The benchmark tables hold no audio, so the samples stand in for it: a track is the line items of eight suppliers, and each track is
mastered in its own way (brightness, gain with clipping, phase, balance, offset, silence at the start), so that quiet and loud, wide
and narrow tracks occur. All metrics are measured on these samples by the operators. The samples count as ``RATE`` a second where
time matters and as ``FS`` a second where bins get their frequencies. What a file tells (sample rate, bit depth, channels) is made up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondine import analysis
from ondine.plans import dynamics, loudness, musical, spectral, stereo  # noqa: F401  whose SQL is joined below
from ondine.plans.kept import kept
from ondine.plans.registry import SQL
from ondine.plans.spectral import FRAMES, FS, SIZE
from ondine.plans.views import LONG, RATE, SHORT, signals_of, signals_sql

#: Query of one measurement: what of its columns goes into the record.
LEVELS = {
    "q_basic_stats": "dc, crest_db as crest",
    "q_silence_edges": "start_ms as silence_start, end_ms as silence_end",
    "q_dynamic_range": "dynamic_range_db as dr",
    "q_clip_events": "events as clip_events",
    "q_micro_contrast": "contrast_db as contrast",
    "q_noise_floor_bits": "noise_floor_db as noise, bits",
    "q_integrated_gated": "gated as lufs",
    "q_lra": "lra",
    "q_loudness_slope_volatility": "slope_db_per_min, volatility",
    "q_true_peak_fir": "true_peak_db as tp, sample_peak_db as sample_peak",
    "q_correlation": "correlation as corr",
    "q_worst_correlation": "worst_1_percent as worst",
    "q_mid_side_width": "width",
    "q_balance": "balance_db as balance",
    "q_mono_impact": "loss_db as mono_loss",
    "q_true_stereo": "true_stereo",
    "q_transient_spacing": "cv, character as timing",
    "q_tempo": "confidence as bpm_conf",
    "q_beat_stability": "stability",
}
SPECTRA = {
    "q_harshness_sibilance": "harshness as harsh, sibilance as sib",
    "q_spectral_tilt": "tilt",
    "q_centroid_rolloff": "rolloff",
    "q_band_level": "level_db as hf",
    "q_key_detect": "confidence as key_conf, tonalness as tonal",
}
LOWS = {"q_subbass_flags": "mono_compatible as sub_ok, phase_issues as low_phase", "q_band_width": "width as low_width"}
#: Metrics whose SQL keeps five digits and not six.
FIVE = {"slope_db_per_min", "volatility", "harsh", "sib", "tilt", "rolloff", "low_width"}

#: How tracks are mastered, step by step: expressions of both engines.
MASTERING = (
    "track, n, l, r, lag(l, 1, 0e0) over (partition by track order by n) as pl, lag(r, 1, 0e0) over (partition by track order by n) as pr",
    "track, n, " + ", ".join(f"greatest(-1e0, least(1e0, ({c} * (1 - abs(track % 5 - 2) / 4e0) + p{c} * (track % 5 - 2) / 4e0) * (1 + track % 7) * (1 + track % 7) / 32e0)) as {c}" for c in "lr"),
    "track, n, l, case when track % 13 = 7 then l else (l * (track * 3 % 5 - 2) / 4e0 + r * (1 - abs(track * 3 % 5 - 2) / 4e0)) * (1 - track % 4 / 8e0) end as r",
    "track, n, " + ", ".join(f"case when n < track % 4 * 500 then 0e0 else {c} + case when track % 3 = 1 then 0.03125e0 else 0e0 end end as {c}" for c in "lr"),
)
#: What the files tell.
TOLD = {"channels": "case when track % 19 = 11 then 1 else 2 end", "sample_rate": "case when track % 16 = 5 then 22050 else 48000 end", "bit_depth": "case when track % 21 = 9 then 8 else 24 end"}


def masters_sql(name: str) -> str:
    made = f"({signals_sql('(l_suppkey // 8)')})"
    for step in MASTERING:
        made = f"(select {step} from {made})"
    return f"{name} as (select *, (l + r) / 2 as mono from {made})"


def masters(spark, d) -> DataFrame:
    """The samples: (track, n, l, r, mono)."""
    made = signals_of(spark, d, F.floor(F.col("l_suppkey") / 8))
    for step in MASTERING:
        made = made.selectExpr(*split(step))
    return made.withColumn("mono", (F.col("l") + F.col("r")) / 2)


def split(columns: str) -> list[str]:
    """The expressions of a select list, which commas outside brackets separate."""
    out, depth = [""], 0
    for sign in columns:
        depth += (sign == "(") - (sign == ")")
        if sign == "," and not depth:
            out.append("")
        else:
            out[-1] += sign
    return out


def measured_sql(view, parts: dict[str, str]) -> str:
    """The SQL of single measurements, each over ``view`` (a function from a name to a table expression), joined by track."""
    whole = f"fx as (select track, n // {SIZE} as frame, n % {SIZE} as i, mono as x from (select *, count(*) over (partition by track, n // {SIZE}) as c from whole) where c = {SIZE})"
    over = lambda sql: sql.replace(LONG, view("long")).replace(SHORT, view("short")).replace(FRAMES, f"{view('whole')}, {whole}")
    best = lambda name: " where rank = 1" if name == "q_key_detect" else ""
    joins = " ".join(f"left join (select track, {columns} from ({over(SQL[name])}){best(name)}) using (track)" for name, columns in parts.items())
    none = [f"null::{t} as {c}" for c, t in (analysis.BANDED | analysis.HEARD).items() if not any(c in columns.replace(",", " ").split() for columns in parts.values())]
    known = [c for c in analysis.LIMITED if not any(x.endswith(f" as {c}") for x in none)]
    finite = ", ".join(f"case when isfinite({c}) then {c} end as {c}" for c in known)
    return f"""select * replace ({finite}){''.join(', ' + x for x in none)} from
      (select * from (with {view('long')} select track, round(count(*) / {RATE}::double, 6) as seconds from long group by track) {joins})"""


SHIMMER, ROBOTIC = "case when hf > -25 then least(100, (hf + 25) * 10) else 0 end", "timing = 'robotic'"
AI = f"least(100, ({SHIMMER}) * 0.6e0 + case when {ROBOTIC} then least(100, greatest(0, (1 - cv) * 100)) * 0.4e0 else 0 end)"
DERIVED = f"tp - lufs as plr, tp - sample_peak as isp, clip_events > 0 as clipped, case when ({AI}) > 0 then {AI} end as ai_score"
TRK = f"""me as ({measured_sql(masters_sql, LEVELS | SPECTRA | LOWS)}),
  tr as (select *, row_number() over (partition by album order by track)::int as track_number from
    (select *, {DERIVED}, {', '.join(f'({e})::int as {c}' for c, e in TOLD.items())}, 'Album ' || (track // 4) as album from me))"""


def digits(metrics: DataFrame) -> DataFrame:
    """Metrics rounded as their SQL rounds them."""
    return metrics.select(*[F.round(c, 5 if c in FIVE else 6).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes])


def tracks(spark, d) -> DataFrame:
    """Measured tracks of albums of four, without their rules' results. They are measured once a session and kept as a table."""

    def made() -> DataFrame:
        own = digits(analysis.measured(masters(spark, d), RATE, weigh=False, frame=SIZE, heard_at=FS))
        own = analysis.derived(own, RATE, 24).withColumns({c: F.expr(f"cast({e} as int)") for c, e in TOLD.items()})
        return analysis.numbered(own, own.select("track", F.concat(F.lit("Album "), F.floor(F.col("track") / 4)).alias("album")))

    return kept(spark, d, "tracks", made)
