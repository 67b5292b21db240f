"""Queries of the channels' relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ondine.operators import stereo as S
from ondine.plans.dynamics import fr, rounded
from ondine.plans.loudness import band_sql
from ondine.plans.registry import query
from ondine.plans.views import LONG, RATE, SHORT, db, long_signals, short_signals

W200, W500 = RATE // 5, RATE // 2


def corr_sql(n: str, a: str = "l", b: str = "r") -> str:
    va, vb = f"(sum({a} * {a}) / {n} - (sum({a}) / {n}) * (sum({a}) / {n}))", f"(sum({b} * {b}) / {n} - (sum({b}) / {n}) * (sum({b}) / {n}))"
    return f"case when {va} > 0 and {vb} > 0 then (sum({a} * {b}) / {n} - (sum({a}) / {n}) * (sum({b}) / {n})) / sqrt({va} * {vb}) else 0 end"


CW = f"cw as ({fr('long', W200, W200 // 2, corr_sql(str(W200)) + f' as c, sqrt(sum(l * l + r * r) / {2 * W200}) as rms')})"


@query(f"with {LONG} select track, round(avg((l + r) / 2), 6) as mean, round(max(abs((l + r) / 2)), 6) as peak, count(*) as samples from long group by track")
def q_mono_downmix(spark, d):
    return rounded(long_signals(spark, d).groupBy("track").agg(F.avg("mono").alias("mean"), F.max(F.abs("mono")).alias("peak"), F.count("*").alias("samples")))


@query(f"with {LONG} select track, round({corr_sql('count(*)')}, 6) as correlation from long group by track")
def q_correlation(spark, d):
    return rounded(S.correlation(long_signals(spark, d)))


@query(f"with {LONG}, {CW} select track, f as frame, round(c, 6) as correlation, round(rms, 6) as rms from cw")
def q_correlation_windowed(spark, d):
    return rounded(S.windowed(long_signals(spark, d), W200))


@query(f"with {LONG}, {CW} select track, round(coalesce(sum(c * rms) filter (rms >= 0.01) / sum(rms) filter (rms >= 0.01), 0), 6) as correlation from cw group by track")
def q_correlation_energy_weighted(spark, d):
    return rounded(S.energy_weighted(long_signals(spark, d), W200))


@query(f"""with {LONG}, {CW}, k as (select *, row_number() over (partition by track order by c, f) as rk from cw), g as (select track, avg(c) as m, list(c order by c) as s, string_agg((f * {W200 // 2})::varchar, ',' order by rk) filter (rk <= 5) as w from k group by track)
  select track, round(m, 6) as mean, round(s[greatest(1, floor(len(s) * 0.01)::bigint)], 6) as worst_1_percent, w as worst_at from g""")
def q_worst_correlation(spark, d):
    return rounded(S.windowed_stats(long_signals(spark, d), W200, RATE))


def width_sql(a: str, b: str) -> str:
    return f"sqrt(avg(({a} + {b}) / 2 * ({a} + {b}) / 2)) as m, sqrt(avg(({a} - {b}) / 2 * ({a} - {b}) / 2)) as s"


@query(f"with {LONG} select track, round(case when m > 0 and s > 0 then least(300, s / m * 100) else 0 end, 6) as width from (select track, {width_sql('l', 'r')} from long group by track)")
def q_mid_side_width(spark, d):
    return rounded(S.width(long_signals(spark, d)))


@query(f"with recursive {SHORT}, {band_sql('bw', 20, 150, 'l,r')} select track, round(case when m > 0 then least(300, s / m * 100) else 0 end, 5) as width from (select track, {width_sql('l_y', 'r_y')} from bw group by track)")
def q_band_width(spark, d):
    return rounded(S.band_width(short_signals(spark, d), RATE, 20, 150), 5)


@query(f"with recursive {SHORT}, {band_sql('bw', 20, 120, 'l,r')}, c as (select track, {corr_sql('count(*)', 'l_y', 'r_y')} as c from bw group by track) select track, round(c, 5) as correlation, c > 0.8 as mono_compatible, c < 0.5 as phase_issues from c")
def q_subbass_flags(spark, d):
    return rounded(S.sub_bass(short_signals(spark, d), RATE), 5)


@query(f"with {LONG} select track, round({db('sqrt(avg(r * r))')} - {db('sqrt(avg(l * l))')}, 6) as balance_db from long group by track")
def q_balance(spark, d):
    return rounded(S.balance(long_signals(spark, d)))


@query(f"""with {LONG}, w as ({fr('long', W500, W500 // 2, f"{db(f'sqrt(sum((l + r) / 2 * (l + r) / 2) / {W500})')} - {db(f'sqrt(sum(l * l + r * r) / {2 * W500})')} as x")}),
  k as (select *, row_number() over (partition by track order by x, f) as rk from w where isfinite(x)), a as (select track, string_agg((f * {W500 // 2})::varchar, ',' order by rk) filter (rk <= 5) as w from k group by track)
  select t.track, round(x, 6) as loss_db, coalesce(w, '') as worst_at from (select track, {db('sqrt(avg((l + r) / 2 * (l + r) / 2))')} - {db('sqrt(avg(l * l + r * r) / 2)')} as x from long group by track) t left join a using (track)""")
def q_mono_impact(spark, d):
    return rounded(S.mono_impact(long_signals(spark, d), W500))


@query(f"""with {LONG}, c as (select *, count(*) over (partition by track) as c from long), g as (select track, sum(abs(l - r)) / least(10000, max(c)) as x from c where n % (c // least(10000, c)) = 0 group by track)
  select track, round(x, 6) as difference, x > 1e-4 as true_stereo from g""")
def q_true_stereo(spark, d):
    return rounded(S.true_stereo(long_signals(spark, d)))
