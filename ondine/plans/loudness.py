"""Queries of loudness, recurrences and peaks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ondine.functions.scalar import INF, exact_avg
from ondine.operators import filters, loudness as L
from ondine.plans.dynamics import fr, rounded
from ondine.plans.registry import query
from ondine.plans.views import LONG, RATE, SHORT, db, long_signals, lufs, short_signals

HOP = RATE // 10


def windows_sql(source: str, seconds: float) -> str:
    w = int(RATE * seconds)
    return f"select track, f as i, f * {HOP} / {RATE}::double as t, {lufs('p')} as lufs from ({fr(source, w, HOP, f'sum(l * l + r * r) / {w} as p', strict=False)})"


ST = f"st as ({windows_sql('long', 3)})"


def short_term(spark, d):
    return L.windows(long_signals(spark, d), RATE, 3)


@query(f"""with {LONG} select 'momentary' as kind, track, i, round(t, 6) as t, round(lufs, 6) as lufs from ({windows_sql('long', 0.4)})
  union all select 'short', track, i, round(t, 6), round(lufs, 6) from ({windows_sql('long', 3)})""")
def q_windowed_loudness(spark, d):
    s = long_signals(spark, d)
    each = [L.windows(s, RATE, sec).select(F.lit(k).alias("kind"), "track", "i", "t", "lufs") for k, sec in (("momentary", 0.4), ("short", 3))]
    return rounded(each[0].unionByName(each[1]))


def integrated_sql(source: str, keys: str = "track") -> str:
    gate = repr(L.ABSOLUTE_GATE) + "::double"
    return f"""select {keys}, coalesce({lufs('g')}, '-inf'::double) as gated, {lufs('u')} as ungated from (select {keys}, avg(p) filter (p >= {gate} and p >= 0.1 * m) as g, avg(p) as u from
      (select *, avg(p) filter (p >= {gate}) over (partition by {keys}) as m from ({fr(source, 400, 300, 'sum(l * l + r * r) / 400 as p', strict=False)})) group by {keys})"""


@query(f"with {LONG} select track, round(gated, 6) as gated from ({integrated_sql('long')})")
def q_integrated_gated(spark, d):
    return rounded(L.integrated(long_signals(spark, d), RATE).select("track", "gated"))


@query(f"with {LONG} select track, round(ungated, 6) as ungated from ({integrated_sql('long')})")
def q_integrated_ungated(spark, d):
    return rounded(L.integrated(long_signals(spark, d), RATE).select("track", "ungated"))


@query(f"""with {LONG}, {ST}, v as (select *, avg(lufs) over (partition by track) as m from st where isfinite(lufs) and lufs > -70),
  g as (select track, count(*) as c, list(lufs order by lufs) filter (lufs >= m - 20) as s from v group by track)
  select track, round(case when c < 2 then 0 else greatest(0, s[floor(len(s) * 0.95::double)::bigint + 1] - s[floor(len(s) * 0.1::double)::bigint + 1]) end, 6) as lra from g""")
def q_lra(spark, d):
    return rounded(L.loudness_range(short_term(spark, d)))


@query(f"""with {LONG}, {ST}, g as (select track, list(lufs order by lufs) filter (isfinite(lufs)) as s from st group by track)
  select track, {', '.join(f"round(s[least(floor(len(s) * {p / 100}::double)::bigint, len(s) - 1) + 1], 6) as p{p}" for p in (10, 50, 90, 95))} from g""")
def q_short_term_percentiles(spark, d):
    return rounded(L.percentiles(short_term(spark, d)))


@query(f"with {LONG}, {ST} select track, round(regr_slope(lufs, t) * 60, 5) as slope_db_per_min, round(stddev_pop(lufs), 5) as volatility from st where isfinite(lufs) and lufs > -70 group by track")
def q_loudness_slope_volatility(spark, d):
    return rounded(L.slope_and_volatility(short_term(spark, d)), 5)


@query(f"""with {LONG}, {ST}, j as (select track, i, t, abs(lufs - lag(lufs, 20) over (partition by track order by i)) as delta from st), k as (select *, row_number() over (partition by track order by delta desc, i) as rank from j where delta > 0.05::double)
  select track, rank::int as rank, round(t, 6) as t, round(delta, 6) as delta from k where rank <= 5""")
def q_abrupt_changes(spark, d):
    return rounded(L.abrupt_changes(short_term(spark, d), least=0.05))


@query(f"with {LONG}, {ST} select track, round(arg_min(t, (-lufs, t)), 6) as loudest, round(arg_min(t, (lufs, t)), 6) as quietest from st where isfinite(lufs) group by track")
def q_loudest_quietest(spark, d):
    return rounded(L.extremes(short_term(spark, d)))


@query(f"""with {LONG}, mo as ({windows_sql('long', 0.4)}), o as (select track, lufs, row_number() over (partition by track order by i) - 1 as j, count(*) over (partition by track) as c from mo where isfinite(lufs)),
  b as (select o.*, b from o, range(20) r(b) where c > 40 and j >= floor(b * (c / 20::double)) and j < floor((b + 1) * (c / 20::double))),
  e as (select track, b, arg_min((j, lufs), (lufs, j)) as lo, arg_min((j, lufs), (-lufs, j)) as hi from b group by track, b)
  select track, b * 2 as k, round(case when lo[1] <= hi[1] then lo[2] else hi[2] end, 6) as lufs from e union all select track, b * 2 + 1, round(case when lo[1] <= hi[1] then hi[2] else lo[2] end, 6) from e
  union all select track, j, round(lufs, 6) from o where c <= 40""")
def q_timeline_minmax(spark, d):
    return rounded(L.timeline(L.windows(long_signals(spark, d), RATE, 0.4), points=40))


def fir_sql(c: str) -> str:
    phases = ", ".join("abs(" + " + ".join(f"{'lag(' + c + ', ' + str(k) + ') over w' if k else c} * {v}::double" for k, v in enumerate(p)) + ")" for p in L.PHASES)
    return f"greatest({phases})"


@query(f"""with {LONG}, p as (select track, n, greatest({fir_sql('l')}, {fir_sql('r')}) as x, greatest(abs(l), abs(r)) as s from long window w as (partition by track order by n))
  select track, round({db('max(x) filter (n >= 11)')}, 6) as true_peak_db, round({db('max(s)')}, 6) as sample_peak_db from p group by track""")
def q_true_peak_fir(spark, d):
    return rounded(L.true_peak(long_signals(spark, d), "l", "r"))


@query(f"with {LONG} select track, round({db('max(greatest(abs(l), abs(r)))')}, 6) as sample_peak_db from long group by track")
def q_sample_peak(spark, d):
    return rounded(L.true_peak(long_signals(spark, d), "l", "r").select("track", "sample_peak_db"))


@query(f"""with {SHORT}, p as (select track, avg(l) as reported, max(abs(r)) as fallback from short group by track)
  select track, round(case when reported > 0 then reported else fallback end, 6) as peak, case when reported > 0 then 'ebur128' else 'fallback' end as source from p""")
def q_verify_true_peak(spark, d):
    both = short_signals(spark, d).groupBy("track").agg(exact_avg(F.col("l")).alias("a"), F.max(F.abs("r")).alias("b"))
    return rounded(both.select("track", L.verified_peak(F.col("a"), F.col("b")).alias("p")).select("track", "p.*"))


def pole(cut: float) -> str:
    return repr(math.exp(-2 * math.pi * cut / RATE)) + "::double"


@query(f"""with recursive {SHORT}, y as (select track, n, (1 - {pole(100)}) * mono as y from short where n = 0 union all select s.track, s.n, (1 - {pole(100)}) * s.mono + {pole(100)} * y.y from y join short s on s.track = y.track and s.n = y.n + 1)
  select track, n, round(y, 6) as y from y""")
def q_one_pole_lp(spark, d):
    made = filters.mapped(short_signals(spark, d).select("track", "n", "mono"), {"y": ("mono", filters.low_pass(100, RATE))})
    return rounded(made.select("track", "n", "y"))


@query(f"""with recursive {SHORT}, y as (select track, n, (1 - {pole(100)}) * mono as y from short where n = 0 union all select s.track, s.n, (1 - {pole(100)}) * s.mono + {pole(100)} * y.y from y join short s on s.track = y.track and s.n = y.n + 1)
  select track, n, round(mono - y, 6) as y from y join short using (track, n)""")
def q_one_pole_hp(spark, d):
    made = filters.mapped(short_signals(spark, d).select("track", "n", "mono"), {"y": ("mono", filters.high_pass(100, RATE))})
    return rounded(made.select("track", "n", "y"))


def band_sql(name: str, low: float, high: float, columns: str = "mono") -> str:
    """A band-pass of columns as a recursion: column c gives c_a (the low-passed input) and c_y (the output)."""
    a, b, cs = pole(low), pole(high), columns.split(",")
    first = ", ".join(f"(1 - {a}) * {c} as {c}_a, (1 - {b}) * ({c} - (1 - {a}) * {c}) as {c}_y" for c in cs)
    step = ", ".join(f"(1 - {a}) * s.{c} + {a} * y.{c}_a, (1 - {b}) * (s.{c} - ((1 - {a}) * s.{c} + {a} * y.{c}_a)) + {b} * y.{c}_y" for c in cs)
    return f"{name} as (select track, n, {first} from short where n = 0 union all select s.track, s.n, {step} from {name} y join short s on s.track = y.track and s.n = y.n + 1)"


@query(f"with recursive {SHORT}, {band_sql('bp', 50, 200)} select track, n, round(mono_y, 6) as y from bp")
def q_one_pole_bandpass(spark, d):
    made = filters.mapped(short_signals(spark, d).select("track", "n", "mono"), {"y": ("mono", filters.band_pass(50, 200, RATE))})
    return rounded(made.select("track", "n", "y"))


def k_sql(name: str, source: str, columns: str, out: str) -> str:
    """K-weighting as a recursion that carries two inputs and two outputs of each stage."""
    (b, a), (c, e) = filters.SHELF, filters.HIGH_PASS_48K
    num = lambda v: f"({v!r}::double)"
    cs = columns.split(",")
    first, step = [], []
    for x in cs:
        y0 = f"{num(b[0])} * {x}"
        first.append(f"{x}::double as {x}_x1, 0::double as {x}_x2, {y0} as {x}_y1, 0::double as {x}_y2, {y0} as {x}_z1, 0::double as {x}_z2")
        y = f"({num(b[0])} * s.{x} + {num(b[1])} * k.{x}_x1 + {num(b[2])} * k.{x}_x2 - {num(a[1])} * k.{x}_y1 - {num(a[2])} * k.{x}_y2)"
        z = f"({y} + {num(c[1])} * k.{x}_y1 + {num(c[2])} * k.{x}_y2 - {num(e[1])} * k.{x}_z1 - {num(e[2])} * k.{x}_z2)"
        step.append(f"s.{x}, k.{x}_x1, {y}, k.{x}_y1, {z}, k.{x}_z1")
    return f"{name} as (select track, n, {', '.join(first)} from {source} where n = 0 union all select s.track, s.n, {', '.join(step)} from {name} k join {source} s on s.track = k.track and s.n = k.n + 1), {out} as (select track, n, {', '.join(f'{x}_z1 as {x}' for x in cs)} from {name})"


@query(f"with recursive {SHORT}, {k_sql('kw', 'short', 'l,r', 'kz')} select track, n, round(l, 6) as l, round(r, 6) as r from kz")
def q_k_weighting(spark, d):
    return rounded(L.weighted(short_signals(spark, d), RATE))


def per_band_sql() -> str:
    out, ctes = [], []
    for name, low, high in filters.BANDS:
        top = min(high, RATE / 2 * 0.95)
        if low < top:
            ctes += [band_sql(f"b_{name}", low, top, "l,r"), f"c_{name} as (select track, n, l_y as l, r_y as r from b_{name})", k_sql(f"k_{name}", f"c_{name}", "l,r", f"z_{name}")]
            out.append(f"select track, '{name}' as band, round(case when isfinite(gated) then gated end, 5) as lufs from ({integrated_sql('z_' + name)})")
    return f"with recursive {SHORT}, {', '.join(ctes)} {' union all '.join(out)}"


@query(per_band_sql())
def q_per_band_loudness(spark, d):
    return rounded(L.per_band(short_signals(spark, d), RATE), 5)


@query(f"""with {LONG}, {ST}, i as ({integrated_sql('long')}), p as (select track, n, greatest({fir_sql('l')}, {fir_sql('r')}) as x, greatest(abs(l), abs(r)) as s from long window w as (partition by track order by n)),
  k as (select track, {db('max(x) filter (n >= 11)')} as tp, {db('max(s)')} as sp from p group by track), m as (select track, max(lufs) as top from st group by track)
  select track, round(tp - gated, 6) as plr, round(tp - top, 6) as psr, round(tp - sp, 6) as isp_margin, round(-14 - gated, 6) as correction,
    case when abs(-14 - gated) < 0.5 then 'at target' when gated < -14 then 'raise' else 'lower' end as advice from i join k using (track) join m using (track)""")
def q_peak_gains(spark, d):
    made = L.peaks_and_loudness(long_signals(spark, d), RATE)
    fix = L.correction(F.col("gated"))
    advice = F.when(F.col("gated") == -INF, "unknown").when(F.abs(fix) < 0.5, "at target").when(fix > 0, "raise").otherwise("lower")
    tp = F.col("true_peak_db")
    return rounded(made.select("track", (tp - F.col("gated")).alias("plr"), (tp - F.col("top")).alias("psr"), (tp - F.col("sample_peak_db")).alias("isp_margin"), fix.alias("correction"), advice.alias("advice")))
