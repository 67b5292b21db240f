"""Queries of scalar functions, windows, frames, catalogs and generated signals."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondine.functions import scalar as X
from ondine.operators import catalog as C
from ondine.operators import framing, postings
from ondine.plans.dynamics import fr, rounded
from ondine.plans.kept import kept
from ondine.plans.registry import query
from ondine.plans.spectral import frames as spec_frames
from ondine.plans.views import EVENTS, LONG, SHORT, event_signals, long_signals, short_signals, table
from ondine.sources import synth


@query("""select event_id, round(least(100, greatest(1, value)), 6) as clamped, round(value / 1048576, 9) as mb, pow(2, ceil(log2(greatest(1, floor(value)))))::bigint as next_pow2, floor(value)::bigint in (1, 2, 4, 8, 16, 32, 64, 128, 256, 512) as is_pow2 from events""")
def q_clamp_mb_pow2(spark, d):
    n = F.floor("value")
    return table(spark, d, "events").select("event_id", F.round(X.clamp(F.col("value"), 1.0, 100.0), 6).alias("clamped"), F.round(X.megabytes(F.col("value")), 9).alias("mb"), X.next_power_of_2(n).alias("next_pow2"), X.is_power_of_2(n).alias("is_pow2"))


@query("select event_id, floor(value - 250 + 0.5)::bigint as half_up from events")
def q_round_js(spark, d):
    return table(spark, d, "events").select("event_id", X.half_up(F.col("value") - 250).alias("half_up"))


@query("""select event_id, printf('%.1f', v) as one, printf('%.2f', v) as two, case when abs(event_id) % 2 = 1 then printf('%.1f', event_id / 4::double + sign(event_id) * 0.01) else printf('%.1f', event_id / 4::double) end as tie, printf('%.2f', event_id + 0.005::double) as near
  from (select event_id, value * 1.0001::double as v from events)""")
def q_tofixed(spark, d):
    """``tie``: quarters, of which the odd ones lie in the middle of two tenths; ``near``: decimal ties that no double holds."""
    v, place = F.col("value") * 1.0001, F.col("event_id")
    return table(spark, d, "events").select("event_id", X.fixed(v, 1).alias("one"), X.fixed(v, 2).alias("two"), X.fixed(place / 4, 1).alias("tie"), X.fixed(place + 0.005, 2).alias("near"))


@query("""select event_id, case when s >= 3600 then (s // 3600) || ':' || lpad(((s % 3600) // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') else (s // 60) || ':' || lpad((s % 60)::varchar, 2, '0') end as duration
  from (select event_id, greatest(0, floor(value * 30 - 100))::bigint as s from events)""")
def q_format_duration(spark, d):
    return table(spark, d, "events").select("event_id", X.duration_text(F.col("value") * 30 - 100).alias("duration"))


@query("select event_id, case when event_id % 10 = 0 then '—' else (floor(value)::bigint // 60) || ':' || lpad((floor(value)::bigint % 60)::varchar, 2, '0') end as time from events")
def q_format_time(spark, d):
    return table(spark, d, "events").select("event_id", X.time_text(F.when(F.col("event_id") % 10 != 0, F.col("value"))).alias("time"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as at, true as past from events")
def q_iso_now(spark, d):
    """The times of the events as text, and whether they lie before now, whose text sorts like its time."""
    at = X.iso_text(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    return table(spark, d, "events").select("event_id", at.alias("at"), (at < X.iso_text(F.current_timestamp())).alias("past"))


@query("select p_partkey, lower(regexp_replace(p_name || ' (' || p_brand || ')', '[^a-zA-Z0-9]', '-', 'g')) as slug from part")
def q_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", X.slug(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


@query("""select p_partkey, case when i > 0 then p_name[1:i - 1] else p_name end as before, case when i > 0 then p_name[i:i + 1] else '' end as match, case when i > 0 then p_name[i + 2:] else '' end as after from (select p_partkey, p_name, instr(lower(p_name), 'ar') as i from part)""")
def q_highlight(spark, d):
    return table(spark, d, "part").select("p_partkey", C.highlighted(F.col("p_name"), "ar").alias("h")).select("p_partkey", "h.*")


@query("select p_partkey, p_name from part where contains(lower(p_name), 'an') or contains(lower(p_type), 'an') or contains(lower(p_brand), 'an')")
def q_text_predicates(spark, d):
    return C.matching(table(spark, d, "part"), " AN ", "p_name", "p_type", "p_brand").select("p_partkey", "p_name")


@query("select p_partkey, p_name from part where p_brand = 'Brand#1' or list_contains([1, 5, 9], p_size)")
def q_catalog_filter(spark, d):
    modes = F.array(F.lit(1), F.lit(5), F.lit(9))
    return table(spark, d, "part").where((F.col("p_brand") == "Brand#1") | F.array_contains(modes, F.col("p_size"))).select("p_partkey", "p_name")


RANKED = """rk as (select p_partkey, p_name, (case when lower(p_name) = '{0}' then 100 when starts_with(lower(p_name), '{0}') then 80 when contains(lower(p_name), '{0}') then 60 else 0 end
  + case when contains(lower(p_brand), '{0}') then 40 else 0 end + case when contains(lower(p_type), '{0}') then 30 else 0 end)::int as score from part)"""


def _score(text: str):
    return C.relevance(text, F.col("p_name"), category=F.col("p_brand"), description=F.col("p_type"))


@query(f"with {RANKED.format('a')} select * from rk where score > 0")
def q_search_ranked(spark, d):
    return C.ranked(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), _score("a"), "p_partkey").select("p_partkey", "p_name", "score")


@query(f"with {RANKED.format('an')} select * from rk where score > 0 order by score desc, p_partkey limit 6")
def q_suggest(spark, d):
    return C.suggestions(table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type"), "an", _score("an"), "p_partkey").select("p_partkey", "p_name", "score")


#: Texts of one query, as a session of a user types them.
TYPED = ("wid", "widget", "d b", "BRAND#1", "econ", "ing", "no such part")


def _typed_sql(text: str) -> str:
    return f"select '{text}' as text, p_partkey, p_name, score from ({RANKED.format(text.lower()).removeprefix('rk as (').removesuffix(')')}) where score > 0"


@query(" union all ".join(_typed_sql(t) for t in TYPED))
def q_search_postings(spark, d):
    columns = ("p_name", "p_brand", "p_type")
    rows = table(spark, d, "part").select("p_partkey", *columns)
    index = postings.indexed(rows, *columns, keep=lambda made, name: kept(spark, d, name, lambda: made, source="part"))
    each = [postings.search(index, t, _score(t), "p_partkey").select(F.lit(t).alias("text"), "p_partkey", "p_name", "score") for t in TYPED]
    return functools.reduce(DataFrame.unionByName, each)


@query("""with c as (select p_type, count(*) as parts, min(p_partkey) as first from part group by p_type) select p.p_partkey, p.p_type, c.parts, c.first from part p left join c using (p_type)""")
def q_catalog_scan(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_type")
    kinds = parts.groupBy("p_type").agg(F.count("*").alias("parts"), F.min("p_partkey").alias("first"))
    return parts.join(kinds, "p_type", "left").select("p_partkey", "p_type", "parts", "first")


@query("select user_id, array_to_string(list_sort(list_concat(list_filter(a, lambda x: not list_contains(b, x)), list_filter(b, lambda x: not list_contains(a, x)))), ',') as toggled from (select user_id, list(distinct event_type) filter (value > 100) as a, list(distinct event_type) filter (value <= 200) as b from events group by user_id) where a is not null and b is not null")
def q_symmetric_difference(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 100, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("value") <= 200, F.col("event_type"))).alias("b"))
    return e.where((F.size("a") > 0) & (F.size("b") > 0)).select("user_id", F.array_join(C.toggled(F.col("a"), F.col("b")), ",").alias("toggled"))


@query("select vec_id, (generate_subscripts(x, 1) - 1)::int as i, round(unnest(x)::double, 6) as x from (select vec_id, list_concat(embedding[6:], embedding[1:5]) as x from embeddings)")
def q_rotate_array(spark, d):
    made = table(spark, d, "embeddings").select("vec_id", X.rotated(F.col("embedding"), F.lit(5)).alias("x"))
    return rounded(made.select("vec_id", F.posexplode("x").alias("i", "v")).select("vec_id", "i", F.col("v").cast("double").alias("x")))


@query("select a.vec_id, round(corr(x, y), 6) as r from (select vec_id, unnest(range(64)) as i, unnest(embedding)::double as x from embeddings) a join (select vec_id - 1 as vec_id, unnest(range(64)) as i, unnest(embedding)::double as y from embeddings) b using (vec_id, i) group by a.vec_id")
def q_pearson_sums(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return rounded(e.join(after, "vec_id").select("vec_id", X.pearson(F.col("x"), F.col("y")).alias("r")))


@query(f"""with {EVENTS} select track, round(avg(mono), 6) as mean, round(stddev_pop(mono), 6) as sd, round(regr_slope(mono, n), 8) as slope, round(20 * log10(sqrt(avg(mono * mono))), 6) as rms_db, round(quantile_cont(mono, 0.3), 6) as p30 from ev group by track""")
def q_util_stats(spark, d):
    made = event_signals(spark, d).groupBy("track").agg(F.avg("mono").alias("mean"), F.stddev_pop("mono").alias("sd"), F.round(F.regr_slope("mono", "n"), 8).alias("slope"), X.db_from_linear(F.sqrt(F.avg(F.col("mono") * F.col("mono")))).alias("rms_db"), F.percentile("mono", 0.3).alias("p30"))
    return made.select("track", *[F.round(c, 6).alias(c) for c in ("mean", "sd")], "slope", F.round("rms_db", 6).alias("rms_db"), F.round("p30", 6).alias("p30"))


@query(f"with {SHORT} select track, case when count(*) < 100 then 0 else (count(*) - 100) // 40 + 1 end as frames from short group by track")
def q_frame_count(spark, d):
    return framing.lengths(short_signals(spark, d)).select("track", framing.frame_count(F.col("length"), 100, 40).alias("frames"))


@query(f"with {SHORT} select track, f as frame, round(e, 6) as energy from ({fr('short', 100, 40, 'sum(mono * mono) as e', strict=False)})")
def q_frames_energy(spark, d):
    return rounded(framing.frames(short_signals(spark, d), 100, 40, F.sum(F.col("mono") * F.col("mono")).alias("energy")))


@query("""select vec_id, round(list_sum(list_transform(range(len(embedding)), lambda i: embedding[i + 1]::double * 0.5 * (1 - cos(2 * pi() * i / 63)))), 6) as hann,
  round(list_sum(list_transform(range(len(embedding)), lambda i: embedding[i + 1]::double * (0.35875 - 0.48829 * cos(2 * pi() * i / 63) + 0.14128 * cos(4 * pi() * i / 63) - 0.01168 * cos(6 * pi() * i / 63)))), 6) as blackman_harris from embeddings""")
def q_window_funcs(spark, d):
    """Vectors of 64 numbers under both windows, summed."""
    under = lambda window: F.aggregate(F.zip_with("embedding", window, lambda x, w: x.cast("double") * w), F.lit(0.0), lambda a, x: a + x)
    return rounded(table(spark, d, "embeddings").select("vec_id", under(framing.hann(64)).alias("hann"), under(framing.blackman_harris(64)).alias("blackman_harris")))


@query(f"""with {LONG}, c as (select track, count(*) as n from long group by track) select track, count as frames, (k * ((n - 4096) // count)) as start from c, (values (30), (20), (10)) v(count), range(30) r(k) where k < count and n >= 4096""".replace("count as frames", "cnt as frames").replace("// count", "// cnt").replace("v(count)", "v(cnt)").replace("k < count", "k < cnt"))
def q_sampled_frames(spark, d):
    lengths = framing.lengths(long_signals(spark, d))
    each = [lengths.select("track", F.lit(k).alias("frames"), F.explode(framing.evenly_spaced(F.col("length"), 4096, k)).alias("start")) for k in (30, 20, 10)]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("select label as track, vec_id as frame, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 6) as energy from embeddings")
def q_frame_iterator(spark, d):
    from ondine.operators.framing_iter import energies

    return rounded(energies(spec_frames(spark, d)))


#: Pitches of the test signals that are made for each supplier.
TONES = "tones as (select s_suppkey as track, 100 + s_suppkey % 400 as low, 500 + s_suppkey % 700 as high from supplier)"


def tones(spark, d):
    key = F.col("s_suppkey")
    return table(spark, d, "supplier").select(key.alias("track"), (100 + key % 400).alias("low"), (500 + key % 700).alias("high"))


@query(f"""with {TONES}, t as (select track, low, high, n, n / 8000::double as s from tones, range(400) r(n)) select track, kind, count(*) as samples, round(sum(x * x), 5) as energy, round(max(abs(x)), 6) as peak from (
  select track, 'sine' as kind, 0.5 * sin(2 * pi() * low * s) as x from t union all select track, 'clipped', greatest(-1, least(1, 1.5 * sin(2 * pi() * high * s))) from t union all select track, 'dc', 0.3 * sin(2 * pi() * high * s) + 0.1 from t
  union all select track, 'tanh', 0.8 * tanh(3 * sin(2 * pi() * low * s)) / tanh(3) from t union all select track, 'alternating', case when n % 2 = 0 then 1 else -1 end from t union all select track, 'silence', 0 from t
  union all select track, 'lufs', sqrt(2) * pow(10, (-14 + 0.691) / 20) * sin(2 * pi() * high * s) from t) group by track, kind""")
def q_synth_signals(spark, d):
    made = synth.signals_of(tones(spark, d), 8000, 400)
    return rounded(made.groupBy("track", "kind").agg(F.count("*").alias("samples"), F.round(F.sum(F.col("x") * F.col("x")), 5).alias("energy"), F.max(F.abs("x")).alias("peak")))


@query(f"""with {TONES} select track, count(*) as samples, round(sum(x * x), 5) as energy, round(sum(x), 5) as total from (select track, sin(2 * pi() * low * 0.05 / ln(high / low::double) * (exp(n / 8000::double / 0.05 * ln(high / low::double)) - 1)) as x from tones, range(400) r(n)) group by track""")
def q_log_sweep(spark, d):
    x = synth.sweep(F.col("n") / 8000, 0.05, F.col("low"), F.col("high"))
    made = synth.sampled(tones(spark, d), 400).select("track", x.alias("x"))
    return made.groupBy("track").agg(F.count("*").alias("samples"), F.round(F.sum(F.col("x") * F.col("x")), 5).alias("energy"), F.round(F.sum("x"), 5).alias("total"))


@query("""select s_suppkey as track, n::int as n, round(avg(('0x' || substr(md5(s_suppkey || ':' || k || ':' || (n >> k)), 1, 13))::bigint / pow(2, 51) - 1), 6) as x from supplier, range(100) r(n), range(16) o(k) group by s_suppkey, n""")
def q_pink_noise(spark, d):
    """Seeded by the supplier: the same on every run, whatever the partitions."""
    made = synth.sampled(table(spark, d, "supplier").select(F.col("s_suppkey").alias("track")), 100)
    return rounded(made.select("track", "n", synth.pink(F.col("n"), F.col("track")).alias("x")))
