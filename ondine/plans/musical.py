"""Queries of tempo and key."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ondine.operators import musical as M
from ondine.plans.dynamics import fr, rounded
from ondine.plans.registry import query
from ondine.plans.spectral import BINS, spectra
from ondine.plans.views import EVENTS, LONG, RATE, event_signals, long_signals

W, H = int(RATE * 0.023), RATE // 100
ENV = f"""ov as (select track, f, x from ({fr('long', W, H, f'sqrt(sum(mono * mono) / {W}) as x', strict=False)}) join (select track, count(*) as c from long group by track) using (track) where f < (c - {W}) // {H}),
  os as (select track, f as i, greatest(0, x - lag(x, 1, 0) over (partition by track order by f)) as e from ov),
  oe as (select track, i, case when max(e) over (partition by track) > 0 then e / max(e) over (partition by track) else e end as e, count(*) over (partition by track) as c from os)"""
AC = "ac as (select a.track, lag, sum(a.e * b.e) / (max(a.c) - lag) as r from oe a, range(30, 151) g(lag), oe b where b.track = a.track and b.i = a.i + lag group by a.track, lag)"
TEMPO = """pk as (select * from (select track, lag, r, r > lag(r) over w and r > lead(r) over w as hit from ac window w as (partition by track order by lag)) where hit),
  p5 as (select *, row_number() over (partition by track order by r desc, lag) as p from pk), cd as (select track, p, floor(6000 / lag::double + 0.5)::bigint as bpm, floor(r * 100 + 0.5)::bigint as c from p5 where p <= 5 and 6000 / lag::double between 40 and 200),
  cn as (select track, p, bpm, floor(c / greatest(max(c) over (partition by track), 1)::double * 100 + 0.5)::bigint as confidence from cd), ck as (select *, row_number() over (partition by track order by confidence desc, p) as rank from cn),
  tb as (select track, arg_min(bpm, rank) as bpm, arg_min(confidence, rank) as confidence, list(bpm) as bs from ck group by track),
  tp as (select track, case when c >= 100 then coalesce(bpm, 120) else 120 end as bpm, case when c >= 100 then coalesce(confidence, 0) else 0 end as confidence, case when c >= 100 then bs end as bs from (select distinct track, c from oe) left join tb using (track))"""


def envelope(spark, d):
    return M.onset_envelope(long_signals(spark, d), RATE)


@query(f"with {LONG}, {ENV} select track, i, round(e, 6) as e from oe")
def q_onset_envelope(spark, d):
    return rounded(envelope(spark, d))


@query(f"with {LONG}, {ENV}, {AC}, {TEMPO} select track, rank::int as rank, bpm, confidence from ck")
def q_autocorr_bpm(spark, d):
    return M.tempo_candidates(envelope(spark, d))


@query(f"with {LONG}, {ENV}, {AC}, {TEMPO} select track, bpm, confidence, coalesce(len(list_filter(bs, lambda b: abs(b - bpm * 2) < 5 or abs(b - bpm / 2) < 3)) > 0, false) as ambiguous from tp")
def q_tempo(spark, d):
    return M.tempo(envelope(spark, d))


def gaps_sql(above: float) -> str:
    return f"(select track, i - lag(i) over (partition by track order by i) as g from (select track, i, e > {above} and e > lag(e) over w and e > lead(e) over w as hit from oe window w as (partition by track order by i)) where hit)"


@query(f"""with {LONG}, {ENV}, {AC}, {TEMPO} select track, case when count(g) + 1 >= 3 and count(g) > 0 then greatest(0, least(100, floor(100 * (1 - sqrt(avg(pow((g - 6000 / bpm::double) / (6000 / bpm::double), 2)))) + 0.5)))::bigint else 0 end as stability
  from tp left join {gaps_sql(0.3)} using (track) group by track""")
def q_beat_stability(spark, d):
    e = envelope(spark, d)
    return M.beat_stability(e, M.tempo(e))


@query(f"""with {LONG}, {ENV}, {AC}, {TEMPO}, g as (select track, count(*) as n, count(*) filter (g > 3000 / bpm::double and g < 12000 / bpm::double) as k, stddev_pop(g) filter (g > 3000 / bpm::double and g < 12000 / bpm::double) / max(6000 / bpm::double) * 100 as v from {gaps_sql(0.2)} join tp using (track) group by track),
  x as (select track, case when n >= 4 and k >= 3 then v else 0 end as v from g) select track, round(v, 5) as drift, case when v > 15 then 'significant' when v > 5 then 'slight' end as note from x""")
def q_tempo_drift(spark, d):
    e = envelope(spark, d)
    return rounded(M.tempo_drift(e, M.tempo(e)), 5)


def chroma_sql(name: str, keys: str) -> str:
    pc = "(floor(12 * log2(freq / 440) + 69 + 0.5)::bigint % 12 + 12) % 12"
    raw = ", ".join(f"coalesce(sum(mag * mag) filter ({pc} = {i}), 0)" for i in range(12))
    return f"{name} as (select {keys}, case when list_sum(c) > 0 then list_transform(c, lambda x: x / list_sum(c)) else c end as chroma from (select {keys}, [{raw}] as c from bn where k >= 1 and freq between 65 and 5000 group by {keys}))"


PROFILES = "pr(ordinal, tonic, key, profile) as (values " + ", ".join(f"({2 * i + m}, {i}, '{n} {'Minor' if m else 'Major'}', {list(M.MINOR if m else M.MAJOR)}::double[])" for i, n in enumerate(M.NAMES) for m in (0, 1)) + ")"


def scores_sql(name: str, chroma: str, keys: str) -> str:
    t = "list_sum({0})"
    dot = lambda a, b: f"list_sum(list_transform(range(1, 13), lambda q: {a}[q] * {b}[q]))"
    return f"""{name} as (select {keys}, ordinal, key, (12 * {dot('ro', 'profile')} - {t.format('ro')} * {t.format('profile')}) / sqrt((12 * {dot('ro', 'ro')} - pow({t.format('ro')}, 2)) * (12 * {dot('profile', 'profile')} - pow({t.format('profile')}, 2))) as score
      from (select {keys}, ordinal, key, profile, list_concat(chroma[tonic + 1:12], chroma[1:tonic]) as ro from {chroma}, pr))"""


@query(f"with {BINS}, {chroma_sql('ch', 'track')} select track, (generate_subscripts(chroma, 1) - 1)::int as pitch, round(unnest(chroma), 6) as share from ch")
def q_chromagram(spark, d):
    return rounded(M.chroma(spectra(spark, d), ["track"]).select("track", F.posexplode("chroma").alias("pitch", "share")))


KEYS = "tk as (select *, row_number() over (partition by {0} order by score desc, ordinal) as rank, min(score) over (partition by {0}) as lo, max(score) over (partition by {0}) as hi from {1})"


@query(f"""with {BINS}, {chroma_sql('ch', 'track')}, {PROFILES}, {scores_sql('ks', 'ch', 'track')}, {KEYS.format('track', 'ks')}
  select track, rank::int as rank, key, floor((score - lo) / (hi - lo) * 100 + 0.5)::bigint as confidence, least(100, greatest(0, floor((hi + 1) * 50 + 0.5)))::bigint as tonalness from tk where rank <= 3""")
def q_key_detect(spark, d):
    return M.top_keys(M.key_scores(M.chroma(spectra(spark, d), ["track"]), ["track"]), ["track"])


@query(f"with {BINS}, {chroma_sql('ch', 'track')}, {PROFILES}, {scores_sql('ks', 'ch', 'track')}, {KEYS.format('track', 'ks')} select track, rank::int as rank, key, round(score, 6) as score from tk where rank <= 3")
def q_top_keys(spark, d):
    scores = M.key_scores(M.chroma(spectra(spark, d), ["track"]), ["track"])
    rank = F.row_number().over(Window.partitionBy("track").orderBy(F.desc("score"), "ordinal"))
    return scores.withColumn("rank", rank).where("rank <= 3").select("track", "rank", "key", F.round("score", 6).alias("score"))


@query(f"""with {BINS}, {PROFILES}, {chroma_sql('ch', 'track')}, {scores_sql('ks', 'ch', 'track')}, {chroma_sql('cf', 'track, frame')}, {scores_sql('kf', 'cf', 'track, frame')},
  a as (select track, arg_min(key, (-score, ordinal)) as main from ks group by track), b as (select track, frame, arg_min(key, (-score, ordinal)) as key from kf group by track, frame),
  s as (select track, case when count(*) < 2 then 100 else floor(avg((key = main)::int) * 100 + 0.5) end::bigint as stability from b join a using (track) group by track)
  select track, stability, case when stability >= 80 then 'stable' when stability >= 50 then 'some variation' else 'ambiguous' end as note from s""")
def q_key_stability(spark, d):
    b = spectra(spark, d)
    best = lambda keys: M.top_keys(M.key_scores(M.chroma(b, keys), keys), keys, most=1)
    return M.key_stability(best(["track"]), best(["track", "frame"]))


@query(f"with {EVENTS} select track, n, round(mono, 6) as x from (select *, mono > lag(mono) over w and mono > lead(mono) over w as hit from ev window w as (partition by track order by n)) where hit")
def q_local_maxima(spark, d):
    return rounded(M.local_maxima(event_signals(spark, d), "n", "mono").select("track", "n", F.col("mono").alias("x")))


@query(f"with {EVENTS} select track, n, round(abs(mono) / max(abs(mono)) over (partition by track), 6) as of_max, round(abs(mono) / sum(abs(mono)) over (partition by track), 6) as of_sum from ev")
def q_normalise_partition(spark, d):
    w = Window.partitionBy("track")
    a = F.abs("mono")
    return rounded(event_signals(spark, d).select("track", "n", (a / F.max(a).over(w)).alias("of_max"), (a / F.sum(a).over(w)).alias("of_sum")))
