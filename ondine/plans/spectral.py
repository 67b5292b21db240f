"""Queries of spectra: the embeddings are frames of 64 samples, their labels the tracks."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ondine.operators import spectral as S
from ondine.operators import whole_spectrum
from ondine.plans.dynamics import rounded
from ondine.plans.registry import query
from ondine.plans.views import SHORT, db, short_signals, table

FS, SIZE = 44100, 64
RES = FS / SIZE

FRAMES = f"fx as (select label as track, vec_id as frame, unnest(range({SIZE})) as i, unnest(embedding)::double as x from embeddings)"
#: Discrete Fourier transform of Hann-windowed frames as a sum over samples.
BINS = f"""{FRAMES},
  bn as (select track, frame, k, k * {RES}::double as freq, sqrt(pow(sum(x * h * cos(2 * pi() * k * i / {SIZE})), 2) + pow(sum(x * h * sin(2 * pi() * k * i / {SIZE})), 2)) as mag
    from (select *, 0.5 * (1 - cos(2 * pi() * i / {SIZE - 1})) as h from fx), range({SIZE // 2}) r(k) group by track, frame, k),
  av as (select track, k, freq, avg(mag) as mag from bn group by track, k, freq)"""
A = "(case when freq < 20 then -80 else 20 * log10(12194::double * 12194 * freq * freq * freq * freq / ((freq * freq + 20.6::double * 20.6) * sqrt((freq * freq + 107.7::double * 107.7) * (freq * freq + 737.9::double * 737.9)) * (freq * freq + 12194::double * 12194))) + 2 end)"
AW = f"aw as (select track, k, freq, mag * pow(10, {A} / 20) as mag from av)"


def frames(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").alias("track"), F.col("vec_id").alias("frame"), F.col("embedding").alias("x"))


def spectra(spark, d):
    return S.bins(frames(spark, d), FS, SIZE)


def average(spark, d):
    return S.averaged(spectra(spark, d))


@query(f"with {BINS} select track, frame, k::int as k, round(freq, 6) as freq, round(mag, 6) as mag from bn")
def q_dft_magnitude(spark, d):
    return rounded(spectra(spark, d))


@query(f"""with px as (select vec_id, unnest(range(80)) as i, unnest(embedding || embedding[1:16])::double as x from embeddings)
  select vec_id, k::int as k, round(sqrt(pow(sum(x * cos(2 * pi() * k * i / 128)), 2) + pow(sum(x * sin(2 * pi() * k * i / 128)), 2)), 6) as mag from px, range(64) r(k) group by vec_id, k""")
def q_padded_magnitude(spark, d):
    """Whole frames, each going on with its own first quarter: 80 samples, padded to 128."""
    longer = table(spark, d, "embeddings").select("vec_id", F.concat("embedding", F.slice("embedding", 1, 16)).alias("x"))
    return rounded(longer.select("vec_id", F.posexplode(S.padded_magnitudes("x")).alias("k", "mag")))


@query(f"""with {SHORT}, w as (select track, pow(2, ceil(log2(count(*))))::bigint as size from short group by track),
  p as (select s.track, n, mono, size, 2 * pi() / size as turn from short s join w using (track)), b as (select track, size, unnest(range(size // 2)) as k from w)
  select p.track, k, round(sqrt(pow(sum(mono * cos(turn * (k * n % p.size))), 2) + pow(sum(mono * sin(turn * (k * n % p.size))), 2)), 6) as mag from p join b using (track) group by p.track, k""")
def q_whole_spectrum(spark, d):
    """Of whole tracks, one a supplier, in blocks of 2,048 values."""
    return rounded(whole_spectrum.magnitudes(short_signals(spark, d).select("track", "n", F.col("mono").alias("x")), 2048))


ROLL = "select {0}, min(freq) as rolloff from (select *, sum(mag * mag) over (partition by {0} order by k) as run, sum(mag * mag) over (partition by {0}) as total from {1}) where run >= 0.85::double * total and total > 0 group by {0}"


@query(f"""with {BINS}, c as (select track, frame, sum(freq * mag * mag) / sum(mag * mag) as c, sum(mag * mag) as t from bn group by track, frame having sum(mag * mag) > 0), r as ({ROLL.format('track, frame', 'bn')})
  select track, round(avg(c), 5) as centroid, round(avg(rolloff), 5) as rolloff from c join r using (track, frame) group by track""")
def q_centroid_rolloff(spark, d):
    return rounded(S.centroid_rolloff(spectra(spark, d)), 5)


@query(f"""with {BINS}, {AW}, h as (select * from aw where k >= 1 and freq >= 20), r as ({ROLL.format('track', 'h')})
  select track, round(sum(freq * mag * mag) / sum(mag * mag), 5) as centroid_a, round(any_value(rolloff), 5) as rolloff_a from h join r using (track) group by track""")
def q_centroid_rolloff_weighted(spark, d):
    return rounded(S.weighted_centroid_rolloff(average(spark, d)), 5)


@query(f"with {BINS} select track, round(freq, 5) as freq, k::int as k, round(run / total, 6) as share from (select *, sum(mag * mag) over (partition by track order by k) as run, sum(mag * mag) over (partition by track) as total from av)")
def q_running_energy_rolloff(spark, d):
    from pyspark.sql import Window

    p = F.col("mag") * F.col("mag")
    run, total = F.sum(p).over(Window.partitionBy("track").orderBy("k")), F.sum(p).over(Window.partitionBy("track"))
    return average(spark, d).select("track", F.round("freq", 5).alias("freq"), "k", F.round(run / total, 6).alias("share"))


def tilt_sql(source: str) -> str:
    return f"select track, round(regr_slope(20 * log10(mag + 1e-10::double), log2(freq)), 5) as tilt from {source} where freq >= 100 and k >= 1 and k <= {int(10000 / RES)} and mag > 0 group by track"


@query(f"with {BINS} {tilt_sql('av')}")
def q_spectral_tilt(spark, d):
    return rounded(S.tilt(average(spark, d), FS, SIZE), 5)


@query(f"with {BINS}, {AW} {tilt_sql('aw')}")
def q_spectral_tilt_weighted(spark, d):
    return rounded(S.tilt(average(spark, d), FS, SIZE, a_weighted=True), 5)


@query(f"with {BINS} select track, round(exp(avg(ln(mag))) / avg(mag), 6) as flatness from av where k >= 1 and mag > 0 group by track")
def q_flatness(spark, d):
    return rounded(S.flatness(average(spark, d)))


def share_sql(a: tuple, b: tuple, weighted: bool) -> str:
    on = lambda x: f"freq >= {x[0]} and freq <= {x[1]} and k >= 1" if weighted else f"k >= {int(x[0] / RES)} and k <= {min(31, int(x[1] / RES))}"
    return f"round(coalesce(sum(mag * mag) filter ({on(a)}) / sum(mag * mag) filter ({on(b)}), 0) * 100, 5)"


@query(f"""with {BINS}, {AW}, a as (select track, {share_sql((2000, 5000), (100, 10000), False)} as harshness, {share_sql((5000, 10000), (100, 15000), False)} as sibilance from av group by track),
  b as (select track, {share_sql((2000, 5000), (100, 10000), True)} as harshness_a, {share_sql((5000, 10000), (100, 15000), True)} as sibilance_a from aw group by track) select * from a join b using (track)""")
def q_harshness_sibilance(spark, d):
    return rounded(S.shares(average(spark, d), FS, SIZE), 5)


BANDS = ", ".join(f"({i}, {a}::double, {b}::double)" for i, (a, b) in enumerate(S.CREST_BANDS))


@query(f"with {BINS}, b(band, low, high) as (values {BANDS}) select track, band, round(sum(mag * mag), 5) as energy, round(max(mag) / sqrt(avg(mag * mag)), 5) as crest from av join b on freq >= low and freq < high group by track, band")
def q_band_crest(spark, d):
    bands = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(S.CREST_BANDS)], "band int, low double, high double")
    return rounded(S.band_energy(average(spark, d), bands), 5)


LEVEL = f"sqrt(2 * sum(case when freq between 8000 and 16000 then mag * mag else 0 end) / count(distinct frame) / {SIZE * sum((0.5 * (1 - math.cos(2 * math.pi * i / (SIZE - 1)))) ** 2 for i in range(SIZE))!r}::double)"


@query(f"with {BINS} select track, round({db(LEVEL)}, 6) as level_db from bn group by track")
def q_band_level(spark, d):
    """Level of the part from 8 to 16 kHz."""
    return rounded(S.band_level(spectra(spark, d), 8000, 16000, SIZE))


@query(f"""with {BINS}, t as (select track, regr_slope(20 * log10(mag + 1e-10::double), log2(freq)) as t from av where freq >= 100 and k >= 1 and k <= {int(10000 / RES)} and mag > 0 group by track),
  h as (select track, {share_sql((2000, 5000), (100, 10000), False)} as h from av group by track), c as (select track, avg(c) as c from (select track, frame, sum(freq * mag * mag) / sum(mag * mag) as c from bn group by track, frame) group by track),
  p as (select track, case when t > 0 then 2 when t > -2 then 1 when t < -5 then -1 else 0 end + case when h > 35 then 1 when h < 15 then -1 else 0 end + case when c > 4000 then 1 when c < 1200 then -1 else 0 end as p from t join h using (track) join c using (track))
  select track, case when p >= 2 then 'bright' when p <= -2 then 'dark' else 'balanced' end as balance from p""")
def q_spectral_balance(spark, d):
    b = spectra(spark, d)
    a = S.averaged(b)
    made = S.tilt(a, FS, SIZE).join(S.shares(a, FS, SIZE), "track").join(S.centroid_rolloff(b), "track")
    return made.select("track", S.balance(F.col("tilt"), F.col("harshness"), F.col("centroid")).alias("balance"))


#: At a lower rate, so that bins 1 to 15 are possible fundamentals.
LOW = 8192
THD = f"""f0 as (select track, frame, arg_min(k, (-mag, k)) as f0, max(mag) as m0 from bn where k >= 1 and k <= {int(2000 / (LOW / SIZE))} and mag > 0 group by track, frame having max(mag) >= 0.001),
  hp as (select f.track, f.frame, f0, m0, h, coalesce((select max(mag) from bn where bn.track = f.track and bn.frame = f.frame and f0 * h < 31 and k between f0 * h - 2 and f0 * h + 2), 0) as peak from f0 f, range(2, 6) r(h)),
  td as (select track, frame, any_value(f0) as f0, sqrt(sum(peak * peak)) / max(m0) * 100 as thd, {', '.join(f"max((peak > m0 * 0.01)::int) filter (h = {h}) as s{h}" for h in range(2, 6))} from hp group by track, frame)"""


@query(f"with {BINS}, {THD} select track, frame, f0::int as f0, round(thd, 5) as thd from td")
def q_thd(spark, d):
    return rounded(S.distortion(S.bins(frames(spark, d), LOW, SIZE), LOW, SIZE, most=0).select("track", "frame", "f0", "thd"), 5)


@query(f"""with {BINS}, {THD}, g as (select track, avg(thd) as t, avg(f0 * {LOW / SIZE}) as f, list_filter([{', '.join(f'case when sum(s{h}) > count(*) * 0.5 then {h} end' for h in range(2, 6))}], lambda x: x is not null) as dd from td group by track)
  select track, floor(t * 100 + 0.5) / 100 as thd_percent, array_to_string(dd, ',') as dominant, floor(f + 0.5)::bigint as fundamental_hz,
    case when t < 0.5 then 'clean' when t < 2 then case when list_has_any(dd, [2, 4]) then 'warm' else 'clean' end when t < 10 then case when list_has_any(dd, [3, 5]) then 'gritty' else 'warm' end else 'clipped' end as character from g""")
def q_dominant_harmonics(spark, d):
    return S.distortion_summary(S.distortion(S.bins(frames(spark, d), LOW, SIZE), LOW, SIZE, most=0), LOW, SIZE)


@query(f"""with {BINS}, c as (select frame, sum(freq * mag * mag) / sum(mag * mag) as c from bn where k >= 1 group by frame),
  p as (select a.frame // 20 as track, avg(b.c) - avg(a.c) as x from c a join c b on b.frame = a.frame + 1 where a.frame % 2 = 0 and a.c > 0 and b.c > 0 group by 1)
  select track, round(x, 5) as asymmetry_hz, case when abs(x) > 200 then case when x > 0 then 'right' else 'left' end end as brighter from p""")
def q_spectral_asymmetry(spark, d):
    b = spectra(spark, d)
    side = lambda odd: b.where(F.col("frame") % 2 == odd).withColumn("frame", F.col("frame") - odd).withColumn("track", F.floor(F.col("frame") / 20))
    return rounded(S.asymmetry(side(0), side(1)), 5)


GRAM = f"sg as (select track, dense_rank() over (partition by track order by frame) - 1 as t, k, case when mag > 0 then greatest(-90, least(0, 20 * log10(mag / {SIZE}))) else -90 end as db from bn where k < 30)"


@query(f"with {BINS}, {GRAM} select track, t::int as t, k::int as k, round(db, 5) as db from sg")
def q_spectrogram(spark, d):
    return rounded(S.spectrogram(spectra(spark, d), FS, SIZE), 5)


@query(f"""with {BINS}, {GRAM}, z as (select track, (max(t) + 1) / 20::double as r, max(t) + 1 as c from sg group by track)
  select track, o::int as t, k::int as k, round(avg(db), 5) as db from sg join z using (track), range(20) q(o) where c > 20 and t >= floor(o * r) and t < floor((o + 1) * r) group by track, o, k
  union all select track, t::int, k::int, round(db, 5) from sg join z using (track) where c <= 20""")
def q_spectrogram_downsample(spark, d):
    return rounded(S.downsampled(S.spectrogram(spectra(spark, d), FS, SIZE), 20), 5)


@query(f"""with {BINS}, {GRAM}, z as (select track, count(distinct t) as frames, max(db) as top from sg group by track), t as (select distinct label as track from embeddings union all select -1)
  select track, frames, round(top, 5) as top from t left join z using (track)""")
def q_spectrogram_lookup_join(spark, d):
    got = S.spectrogram(spectra(spark, d), FS, SIZE).groupBy("track").agg(F.countDistinct("t").alias("frames"), F.max("db").alias("top"))
    tracks = table(spark, d, "embeddings").select(F.col("label").alias("track")).distinct().unionByName(spark.createDataFrame([(-1,)], "track int"))
    return rounded(tracks.join(got, "track", "left"), 5)
