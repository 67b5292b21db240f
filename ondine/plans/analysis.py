"""Queries of whole records: what every operator measures on a track, and what its album makes of it.

Their SQL joins the SQL of the single measurements.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ondine import analysis
from ondine.plans.album import SUMMARY
from ondine.plans.dynamics import rounded
from ondine.plans.kept import kept
from ondine.plans.registry import query
from ondine.plans.rules import ISSUES, WARNINGS, codes_sql
from ondine.plans.spectral import FS, SIZE
from ondine.plans.tracks import DERIVED, LEVELS, SPECTRA, digits, measured_sql
from ondine.plans.views import RATE, long_signals, signals_sql

PARTS = LEVELS | SPECTRA
RECORDS = f"""me as ({measured_sql(lambda name: f"{name} as ({signals_sql('l_returnflag || l_linestatus')})", PARTS)}),
  re as (select *, {DERIVED}, {RATE} as sample_rate, 24 as bit_depth, 2 as channels, left(track, 1) as album from me),
  ru as (select *, len({codes_sql(ISSUES)}) as n_issues, len({codes_sql(WARNINGS)}) as n_warnings, array_to_string({codes_sql(ISSUES)}, ',') as issue_codes, array_to_string({codes_sql(WARNINGS)}, ',') as warning_codes,
    row_number() over (partition by album order by track)::int as track_number from re)"""
KEPT = ["track", "album", "track_number", "seconds", *(c.split(" as ")[-1].strip() for columns in PARTS.values() for c in columns.split(",")), "plr", "isp", "clipped", "ai_score", "n_issues", "n_warnings"]


def records(spark, d):
    """The tracks of the long signals, which hold no weighting and no filtered lows; an album is all tracks of one first letter."""

    def made():
        signals = kept(spark, d, "long", lambda: long_signals(spark, d))
        own = digits(analysis.measured(signals, RATE, weigh=False, bands=False, frame=SIZE, heard_at=FS))
        own = analysis.report(analysis.derived(own, RATE, 24))
        return analysis.numbered(own, own.select("track", F.substring("track", 1, 1).alias("album")))

    return kept(spark, d, "records", made)


@query(f"with {RECORDS} select {', '.join(f'round({c}, 6) as {c}' if c in ('plr', 'isp', 'ai_score') else c for c in KEPT)}, issue_codes, warning_codes from ru")
def q_track_analysis(spark, d):
    codes = lambda c: F.array_join(F.transform(c, lambda x: x["code"]), ",")
    return rounded(records(spark, d).select(*KEPT, codes(F.col("issues")).alias("issue_codes"), codes(F.col("warnings")).alias("warning_codes")))


@query(f"""with {RECORDS}, {SUMMARY}, j as (select album, lufs, row_number() over w - 1 as place, abs(lufs - lag(lufs) over w) as jump from ru where lufs is not null window w as (partition by album order by track_number)),
  g as (select album, max(lufs) - min(lufs) as spread, coalesce(max(jump), 0) as jump, arg_min(place, (-jump, place)) filter (jump is not null) as k from j group by album)
  select al.*, round(spread, 6) as loudness_spread, round(jump, 6) as worst_jump, case when jump > 0 then k::int end as worst_jump_at, greatest(0, floor(100 - jump * 10 + 0.5))::bigint as sequence_score from al left join g using (album)""")
def q_album_analysis(spark, d):
    return rounded(analysis.album_report(records(spark, d)))
