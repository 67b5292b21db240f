"""Queries of levels and dynamics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ondine.operators import dynamics as D
from ondine.operators.following import first_at_or_below
from ondine.plans.registry import query
from ondine.plans.views import LONG, RATE, SHORT, db, long_signals, short_signals

W10, W20, W50, W100 = RATE // 100, RATE // 50, RATE // 20, RATE // 10


def rounded(df, digits: int = 6):
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def fr(source: str, window: int, hop: int, aggregates: str, strict: bool = True) -> str:
    """SQL of whole frames: track, f and aggregates."""
    ends = f"having count(*) = {window}" + (f" and f * {hop} + {window} < max(length)" if strict else "")
    return f"""select track, f, {aggregates} from (select *, count(*) over (partition by track) as length,
      unnest(range(greatest(cast(ceil((n - {window} + 1) / {hop}::double) as bigint), 0), n // {hop} + 1)) as f from {source}) group by track, f {ends}"""


@query(f"""with {LONG} select track, round(avg(mono), 6) as dc, round(sqrt(avg(mono * mono)), 6) as rms, round(max(abs(mono)), 6) as peak,
  round({db('max(abs(mono))')}, 6) as peak_db, round({db('sqrt(avg(mono * mono))')}, 6) as rms_db, round({db('max(abs(mono))')} - {db('sqrt(avg(mono * mono))')}, 6) as crest_db from long group by track""")
def q_basic_stats(spark, d):
    return rounded(D.basic_stats(long_signals(spark, d)))


@query(f"""with {LONG}, e as (select track, min(n) filter (greatest(abs(l), abs(r)) > 0.001) as a, max(n) filter (greatest(abs(l), abs(r)) > 0.001) as b, count(*) as c from long group by track)
  select track, floor(coalesce(a, c) / {RATE} * 1000 + 0.5)::bigint as start_ms, floor(coalesce(c - 1 - b, c) / {RATE} * 1000 + 0.5)::bigint as end_ms from e""")
def q_silence_edges(spark, d):
    return D.silence_edges(long_signals(spark, d), RATE)


DR = """v as (select track, abs(mono) as a, n, count(*) over (partition by track) as c from {0}),
  w as (select track, list(a order by a) filter (n % greatest(1, c // 10000) = 0 and a > 1e-4) as s, max(a) as peak from v group by track),
  dr as (select track, greatest(0, 20 * log10(coalesce(s[floor(len(s) * 0.95)::bigint + 1], peak)) - 20 * log10(coalesce(s[floor(len(s) * 0.1)::bigint + 1], 1e-4))) as dr from w)"""


@query(f"with {LONG}, {DR.format('long')} select track, round(dr, 6) as dynamic_range_db from dr")
def q_dynamic_range(spark, d):
    return rounded(D.dynamic_range(long_signals(spark, d)))


RUNS = """x as (select track, n, 0 as ch, l as x from {0} union all select track, n, 1, r from {0}),
  i as (select track, ch, n, n - row_number() over (partition by track, ch order by n) as island from x where abs(x) >= 0.9999),
  runs as (select track, ch, min(n) as start, count(*) as duration from i group by track, ch, island)"""


@query(f"""with {LONG}, {RUNS.format('long')}, k as (select *, row_number() over (partition by track order by duration desc, ch, start) as rk from runs),
  g as (select track, sum(duration)::bigint as clipped, count(*) as events, string_agg(start::varchar, ',' order by rk) filter (rk <= 5) as worst from k group by track)
  select t.track, coalesce(clipped, 0) as clipped, coalesce(events, 0) as events, round(coalesce(events, 0) / (c / {RATE} / 60), 6) as per_minute, coalesce(worst, '') as worst
  from (select track, count(*) as c from long group by track) t left join g using (track)""")
def q_clip_events(spark, d):
    return rounded(D.clip_events(long_signals(spark, d), RATE))


@query(f"with {SHORT}, {RUNS.format('short')} select track, ch as channel, start, duration from runs")
def q_clip_union_channels(spark, d):
    return D.clip_runs(short_signals(spark, d))


@query(f"""with {LONG}, p as ({fr('long', W50, W50 // 2, 'max(greatest(abs(l), abs(r))) >= 0.95 as high')}),
  q as (select *, high and not lag(high, 1, false) over (partition by track order by f) as rise from p),
  g as (select track, count(*) filter (rise) as clusters, avg(high::int) as ratio from q group by track)
  select track, clusters, round(ratio, 6) as ratio, case when ratio > 0.3 then 'persistent' when ratio < 0.05 and clusters < 10 then 'sporadic' else 'mixed' end as kind from g""")
def q_peak_clusters(spark, d):
    return rounded(D.peak_clusters(long_signals(spark, d), W50))


CONTRAST = f"""mc as (select track, coalesce(v[len(v) // 2 + 1], 0) as contrast from (select track, list(c order by c) filter (rms > 1e-4 and peak > 0 and isfinite(c) and c > 0) as v from
  (select track, peak, rms, {db('peak')} - {db('rms')} as c from ({fr('{0}', W100, W100 // 2, 'max(abs(mono)) as peak, sqrt(sum(mono * mono) / ' + str(W100) + ') as rms')})) group by track))"""


@query(f"with {LONG}, {CONTRAST.replace('{0}', 'long')} select track, round(contrast, 6) as contrast_db from mc")
def q_micro_contrast(spark, d):
    return rounded(D.micro_contrast(long_signals(spark, d), W100))


ENVELOPE = f"env as (select track, f, case when rms > 1e-4 then 20 * log10(rms) else -100 end as level from ({fr('{0}', W10, W10 // 2, 'sqrt(sum(mono * mono) / ' + str(W10) + ') as rms')}))"


@query(f"""with {LONG}, {ENVELOPE.replace('{0}', 'long')}, s as (select track, (level - lag(level) over (partition by track order by f)) / {W10 // 2 / RATE * 1000}::double as s from env)
  select track, round(coalesce(v[len(v) // 2 + 1], 0), 6) as attack_index from (select track, list(s order by s) filter (s > 0.1) as v from s group by track)""")
def q_attack_speed(spark, d):
    return rounded(D.attack_speed(long_signals(spark, d), W10, RATE))


@query(f"""with {SHORT}, {ENVELOPE.replace('{0}', 'short')}, p as (select *, lag(level) over w as a, lead(level) over w as b from env window w as (partition by track order by f)),
  t as (select p.track, p.f, min(e.f) - p.f as k from p join env e on e.track = p.track and e.f > p.f and e.level <= p.level - 10 where p.level > a and p.level > b and p.level > -40 group by p.track, p.f),
  m as (select track, list(k * {W10 // 2 / RATE * 1000}::double order by k) filter (k * {W10 // 2 / RATE * 1000} < 2000) as v from t group by track)
  select track, round(coalesce(v[len(v) // 2 + 1], 0), 6) as tail_ms from (select distinct track from env) left join m using (track)""")
def q_release_tail(spark, d):
    return rounded(D.release_tail(short_signals(spark, d), W10, RATE))


@query(f"""with {SHORT}, w as (select track, n, mono as x, lag(mono) over o as a, lead(mono) over o as b from short window o as (partition by track order by n)), p as (select track, n as place, x / 2 as level from w where x > a and x > b and x > 0)
  select p.track, place as at, round(level, 6) as level, min(s.n) as found from p left join short s on s.track = p.track and s.n > place and s.mono <= level group by p.track, place, level""")
def q_first_below(spark, d):
    """From each positive peak of a track to the first later sample that is no more than half of it."""
    s = short_signals(spark, d)
    order = Window.partitionBy("track").orderBy("n")
    peaks = s.withColumns({"a": F.lag("mono").over(order), "b": F.lead("mono").over(order)}).where((F.col("mono") > F.col("a")) & (F.col("mono") > F.col("b")) & (F.col("mono") > 0))
    events = peaks.select("track", F.col("n").alias("at"), (F.col("mono") / 2).alias("level"))
    return rounded(first_at_or_below(s.select("track", "n", F.col("mono").alias("x")), events, block=256))


GAP = int(RATE * 0.05 / (W10 // 2))
#: Accepted onsets: a recursion from each to the first candidate that is late enough.
ONSETS = f"""en as ({fr('{0}', W10, W10 // 2, 'sum(mono * mono) / ' + str(W10) + ' as e')}),
  ri as (select track, f - 1 as i, greatest(0, e - lag(e) over (partition by track order by f)) as rise, f from en),
  ca as (select track, i from (select *, avg(rise) over (partition by track) + 2 * stddev_pop(rise) over (partition by track) as t from ri where f > 0) where rise > t),
  ons as (select track, min(i) as i from ca group by track union all select o.track, (select min(c.i) from ca c where c.track = o.track and c.i - o.i >= {GAP}) from ons o where o.i is not null)"""


@query(f"with recursive {SHORT}, {ONSETS.replace('{0}', 'short')} select track, i from ons where i is not null")
def q_transients(spark, d):
    return D.transients(short_signals(spark, d), W10, RATE)


SPACING = f"""sp as (select t.track, coalesce(k, 0) as onsets, coalesce(k, 0) / (c / {RATE} / 60) as per_minute, case when k >= 3 then cv else 0 end as cv from (select track, count(*) as c from {{0}} group by track) t left join
  (select track, count(*) as k, stddev_pop(g) / avg(g) as cv from (select track, (i - lag(i) over (partition by track order by i)) * {W10 // 2} / {RATE}::double as g from ons where i is not null) group by track) using (track))"""


@query(f"""with recursive {SHORT}, {ONSETS.replace('{0}', 'short')}, {SPACING.replace('{0}', 'short')}
  select track, onsets, round(per_minute, 6) as per_minute, round(cv, 6) as cv, case when onsets < 3 then 'natural' when cv < 0.08 then 'robotic' when cv < 0.18 then 'tight' when cv < 0.4 then 'natural' else 'loose' end as character from sp""")
def q_transient_spacing(spark, d):
    return rounded(D.transient_spacing(short_signals(spark, d), W10, RATE))


@query(f"""with recursive {SHORT}, {ONSETS.replace('{0}', 'short')}, {SPACING.replace('{0}', 'short')},
  o as (select track, i * {W10 // 2} as at0, (select count(*) from short s where s.track = ons.track) as c from ons where i is not null),
  j as (select o.track, at0, n - at0 as d0, mono from o join short s on s.track = o.track and s.n >= at0 - {W20 // 4} and s.n < at0 + {W20 * 10} where at0 >= {W20} and at0 + {W20} < c),
  k as (select track, at0, sqrt(sum(mono * mono) filter (d0 < 0) / {W20 // 4}) as pre, sqrt(sum(mono * mono) filter (d0 >= 0 and d0 < {W20 // 4}) / {W20 // 4}) as post, max(abs(mono)) filter (d0 >= 0 and d0 < {W20}) as peak from j group by track, at0),
  m as (select k.*, (20 * log10(post) - 20 * log10(pre)) / {W20 // 4 / RATE * 1000}::double as s, (select min(d0) from j where j.track = k.track and j.at0 = k.at0 and d0 >= {W20} and abs(mono) <= peak * 0.316::double) / {RATE} * 1000 as ms from k where pre > 1e-4 and post > 1e-4),
  g as (select track, list(s order by s) filter (s > 0.1) as ss, list(ms order by ms) filter (peak > 0.01 and ms > 1 and ms < 500) as ds from m group by track)
  select track, case when onsets >= 2 then floor(case when len(ss) > 0 then least(100, greatest(0, ss[len(ss) // 2 + 1] * 50)) else 50 end + 0.5)::bigint else 50 end as steepness,
    case when onsets >= 2 then floor(least(100, greatest(0, (1 - cv * 2) * 100)) + 0.5)::bigint else 100 end as uniformity,
    case when onsets >= 2 and len(ss) > 0 then floor(10 / greatest(ss[len(ss) // 2 + 1], 0.1::double) * 10 + 0.5) / 10 end as attack_ms, case when onsets >= 2 then floor(ds[len(ds) // 2 + 1] + 0.5)::bigint end as decay_ms from sp left join g using (track)""")
def q_transient_sharpness(spark, d):
    return rounded(D.transient_sharpness(short_signals(spark, d), W20, RATE, W10))


STATS = f"""st as (select track, {db('max(abs(mono))')} - {db('sqrt(avg(mono * mono))')} as crest from {{0}} group by track),
  cl as (select t.track, coalesce(k, 0) / (c / {RATE} / 60) as density, coalesce(k, 0) > 0 as clipped from (select track, count(*) as c from {{0}} group by track) t left join (select track, count(*) as k from runs group by track) using (track))"""


def metrics(signals):
    """Crest, range, contrast and clipping of each track."""
    stats = D.basic_stats(signals).select("track", F.col("crest_db").alias("crest"))
    clips = D.clip_events(signals, RATE).select("track", F.col("per_minute").alias("density"), (F.col("events") > 0).alias("clipped"))
    return stats.join(D.dynamic_range(signals).withColumnRenamed("dynamic_range_db", "dr"), "track").join(D.micro_contrast(signals, W100).withColumnRenamed("contrast_db", "contrast"), "track").join(clips, "track")


@query(f"""with {SHORT}, {DR.format('short')}, {RUNS.format('short')}, {STATS.format('short')}, m as (select * from st join dr using (track) join cl using (track))
  select track, case when crest < 5 and dr < 5 then 'brickwall' when crest < 7 and dr < 8 then 'heavy' when crest < 10 and dr < 12 then 'moderate' when crest < 14 then 'light' end as character,
    (case when crest < 5 and dr < 5 then 20 when crest < 7 and dr < 8 then floor(20 / greatest(crest, 1) + 0.5) when crest < 10 and dr < 12 then floor(15 / greatest(crest, 1) + 0.5) when crest < 14 then 2 end)::double as ratio,
    (case when crest < 5 and dr < 5 then -1 when crest < 7 and dr < 8 then -6 when crest < 10 and dr < 12 then -12 when crest < 14 then -18 end)::double as threshold_db,
    case when crest < 5 and dr < 5 then case when density > 10 then 'high' else 'medium' end when crest < 7 and dr < 8 then 'medium' when crest < 10 and dr < 12 and crest < 8 then 'medium' else 'low' end as confidence from m""")
def q_compression(spark, d):
    made = metrics(short_signals(spark, d))
    return made.select("track", D.compression(F.col("crest"), F.col("dr"), F.col("density")).alias("c")).select("track", "c.*")


@query(f"""with {SHORT}, {DR.format('short')}, {RUNS.format('short')}, {STATS.format('short')}, {CONTRAST.replace('{0}', 'short')}, m as (select * from st join dr using (track) join cl using (track) join mc using (track)),
  s as (select track, least(100, greatest(0, 100 - case when crest < 6 then (6 - crest) * 8 when crest < 10 then (10 - crest) * 3 else 0 end - case when dr < 6 then (6 - dr) * 6 when dr < 10 then (10 - dr) * 2 else 0 end
    - case when contrast < 4 then (4 - contrast) * 5 else 0 end - case when clipped then 15 else 0 end)) as score from m)
  select track, round(score, 6) as score, case when score >= 85 then 'Excellent dynamic preservation' when score >= 70 then 'Good dynamics, moderate processing' when score >= 50 then 'Compressed, reduced dynamics' else 'Heavily compressed/limited' end as note from s""")
def q_preservation(spark, d):
    made = metrics(short_signals(spark, d)).withColumn("score", D.preservation(F.col("crest"), F.col("dr"), F.col("clipped"), F.col("contrast")))
    return rounded(made.select("track", "score", D.preservation_note(F.col("score")).alias("note")))


@query(f"""with {LONG}, q as (select track, min(e) filter (e > 0) as e from ({fr('long', 4096, 4096, 'sum(mono * mono) as e')}) group by track), r as (select t.track, coalesce(10 * log10(e / 4096), 'inf'::double) as nf from (select distinct track from long) t left join q using (track))
  select track, round(nf, 6) as noise_floor_db, (case when nf = 'inf'::double then 8 else least(24, greatest(8, floor((-nf - 6) / 6 + 0.5))) end)::int as bits from r""")
def q_noise_floor_bits(spark, d):
    return rounded(D.noise_floor(long_signals(spark, d)))
