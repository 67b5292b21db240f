"""Queries of albums and their export."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import functions as F

from ondine.operators import album as A
from ondine.plans.dynamics import rounded
from ondine.plans.registry import query
from ondine.plans.rules import RULED, ruled
from ondine.plans.tracks import TRK, tracks
from ondine.plans.views import table
from ondine.staging import remove, shared_dir

SUMMARY = """al as (select album, count(*) as tracks, round(avg(lufs), 1) as avg_lufs, round(min(lufs), 1) as min_lufs, round(max(lufs), 1) as max_lufs, round(stddev_pop(lufs), 2) as lufs_sd, round(avg(lra), 1) as avg_lra, round(coalesce(max(tp), -3), 1) as max_tp, round(avg(tp), 1) as avg_tp,
  round(avg(dr), 1) as avg_dr, round(avg(crest), 1) as avg_crest, round(avg(corr), 2) as avg_corr, round(avg(tilt), 1) as avg_tilt, round(avg(harsh), 0) as avg_harsh, round(coalesce(avg(ai_score), 0), 1) as avg_ai, count(*) filter (coalesce(tp, -10) > -1) as above_peak,
  count(*) filter (clipped) as with_clipping, count(*) filter (low_phase) as with_phase, count(*) filter (coalesce(ai_score, 0) > 30) as with_artifacts, count(*) filter (n_issues > 0) as with_issues, count(*) filter (n_warnings > 0) as with_warnings,
  sum(n_issues)::bigint as issues, sum(n_warnings)::bigint as warnings, bool_and(n_issues = 0) as ready, round(sum(seconds), 6) as seconds from ru group by album)"""


@query(f"with {RULED}, {SUMMARY} select * from al")
def q_album_summary(spark, d):
    return rounded(A.summary(ruled(spark, d)))


@query(f"""with {TRK}, j as (select album, lufs, row_number() over w - 1 as place, abs(lufs - lag(lufs) over w) as jump from tr window w as (partition by album order by track_number)),
  g as (select album, max(lufs) - min(lufs) as spread, coalesce(max(jump), 0) as jump, arg_min(place, (-jump, place)) filter (jump is not null) as k from j group by album)
  select album, round(spread, 6) as spread, round(jump, 6) as jump, case when jump > 0 then k::int end as at, greatest(0, floor(100 - jump * 10 + 0.5))::bigint as score from g""".replace(" as at,", ' as "at",'))
def q_album_sequence(spark, d):
    return rounded(A.sequence(tracks(spark, d)))


@query(f"""with {TRK}, w as (select *, avg(tilt) over (partition by album) as mt, avg(harsh) over (partition by album) as mh, avg(width) over (partition by album) as mw, count(*) over (partition by album) as c from tr)
  select album, track_number from w where c >= 3 and (abs(tilt - mt) > 2 or abs(harsh - mh) > 15 or abs(width - mw) > 25)""")
def q_deviating(spark, d):
    return A.deviating(tracks(spark, d))


@query(f"""with {TRK}, m as (select album, count(*) as c, list(lufs order by lufs) as a, list(tilt order by tilt) as b from tr group by album), x as (select tr.*, c, a[len(a) // 2 + 1] as ml, b[len(b) // 2 + 1] as mt from tr join m using (album)),
  r as (select album, track_number, list_filter([case when abs(lufs - ml) > 4 then case when lufs > ml then 'louder' else 'quieter' end end, case when abs(tilt - mt) > 3 then case when tilt > mt then 'brighter' else 'darker' end end], lambda x: x is not null) as rs from x where c >= 3)
  select album, track_number, array_to_string(rs, ' and ') as reason from r where len(rs) > 0""")
def q_album_outliers(spark, d):
    return A.outliers(tracks(spark, d))


@query(f"""with {TRK} select album, floor(avg(case when lufs > -9 or lufs < -20 then 6 when lufs > -11 or lufs < -18 then 8 else 10 end) + 0.5)::bigint as loudness, floor(avg(case when clipped then 5 else 10 end) + 0.5)::bigint as dynamics,
  floor(avg(case when corr < 0 then 4 when corr < 0.5 then 7 else 10 end) + 0.5)::bigint as translation, floor(avg(case when harsh > 35 then 6 when harsh > 28 then 8 else 10 end) + 0.5)::bigint as spectral,
  floor(avg(case when tp - 14 - lufs > 0 then 5 when tp - 14 - lufs > -1 then 7 else 10 end) + 0.5)::bigint as streaming from tr group by album""")
def q_score_breakdown(spark, d):
    return A.breakdown(tracks(spark, d))


@query(f"""with {RULED}, {SUMMARY} select album, array_to_string(list_filter([case when avg_lufs > -10 then 'loud' when avg_lufs < -16 then 'quiet' else 'optimal' end, case when above_peak > 0 then 'peaks' end, case when with_clipping > 0 then 'clipping' end, case when avg_dr < 6 then 'dynamics' end, case when with_phase > 0 then 'phase' end], lambda x: x is not null), ',') as findings,
  case when ready then case when avg_lufs > -14 then 'Distribution Ready (with normalization)' else 'Distribution Ready' end else 'Address issues before distribution' end as note from al""")
def q_key_findings(spark, d):
    return A.summary(ruled(spark, d)).select("album", F.array_join(A.findings(), ",").alias("findings"), A.ready_note(F.col("ready"), F.col("avg_lufs")).alias("note"))


@query(f"""with {RULED} select album, track_number as number, round(seconds, 6) as seconds, round(lufs, 6) as lufs, round(tp, 6) as tp, round(dr, 6) as dr, n_issues as issues, n_warnings as warnings from ru""")
def q_export_overview(spark, d):
    return rounded(ruled(spark, d).select("album", F.col("track_number").alias("number"), "seconds", "lufs", "tp", "dr", F.col("n_issues").alias("issues"), F.col("n_warnings").alias("warnings")))


@query(f"with {RULED} select coalesce(album, '*') as album, count(*) as tracks, sum(n_issues)::bigint as issues from ru group by rollup (album)")
def q_album_rollup(spark, d):
    made = ruled(spark, d).rollup("album").agg(F.count("*").alias("tracks"), F.sum("n_issues").alias("issues"))
    return made.withColumn("album", F.coalesce("album", F.lit("*")))


@query()
def q_export_json(spark, d):
    from ondine.sources.export import report

    return report(ruled(spark, d), "Album")


@query(f"""with {RULED}, {SUMMARY}, li as (select album, track_number, seconds, lufs, tp, dr, n_issues, n_warnings from ru)
  select album, lower(regexp_replace(album, '[^a-zA-Z0-9]', '-', 'g')) || '-analysis.json' as file, '1.0' as version, 'Album' as kind, round(al.avg_lufs, 6) as avg_lufs, al.ready, al.issues as album_issues,
    li.track_number, round(li.seconds, 6) as seconds, round(li.lufs, 6) as lufs, round(li.tp, 6) as tp, round(li.dr, 6) as dr, li.n_issues, li.n_warnings from al join li using (album)""")
def q_export_readback(spark, d):
    """The report's files, one for each album, read and parsed again: one row per track, with what its album's head says."""
    from ondine.sources.export import report, write

    path = f"{shared_dir(spark)}/ondine-reports-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    write(report(ruled(spark, d), "Album"), path)
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file"), F.col("value").alias("json"))

    track = "array<struct<track_number:int,seconds:double,lufs:double,tp:double,dr:double,n_issues:bigint,n_warnings:bigint>>"
    head = "struct<avg_lufs:double,ready:boolean,issues:bigint>"
    docs = files.withColumn("x", F.from_json("json", f"version string, kind string, name string, summary {head}, tracks {track}"))
    rows = docs.select(F.col("x.name").alias("album"), "file", "x.version", "x.kind", "x.summary.avg_lufs", "x.summary.ready", F.col("x.summary.issues").alias("album_issues"), F.explode("x.tracks").alias("t"))
    return rounded(rows.select("*", "t.*").drop("t"))


def _listed(pick: int) -> str:
    """SQL of the texts of FINDINGS that hold: their wording (0) or what to do about them (2)."""
    when = {"loud": "avg_lufs > -10", "quiet": "avg_lufs < -16", "optimal": "avg_lufs between -16 and -10", "peaks": "above_peak > 0", "clipping": "with_clipping > 0", "dynamics": "avg_dr < 6", "phase": "with_phase > 0"}
    text = lambda f: f"printf('{f[0]}', {f[1]})" if pick == 0 and f[1] else f"'{f[pick]}'"
    return "list_filter([" + ", ".join(f"case when {when[code]} then {text(f)} end" for code, f in A.FINDINGS.items() if f[pick]) + "], lambda x: x is not null)"


@query(f"""with {RULED}, {SUMMARY}, e as (select album, (select max(o_orderdate) from orders)::date as day, {_listed(0)} as a, {_listed(2)} as b from al),
  u as (select album, day, 'finding' as kind, unnest(range(len(a))) as place, unnest(a) as text from e union all select album, day, 'recommendation', unnest(range(len(b))), unnest(b) from e)
  select album, strftime(day, '%Y-%m-%dT00:00:00.000Z') as exported, kind, place::int as place, text from u""")
def q_export_findings(spark, d):
    """What the report's files say in words, read back: one row per finding and recommendation. The day of the last order counts as that of the export."""
    from ondine.sources.export import report, write

    path = f"{shared_dir(spark)}/ondine-reports-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    last = table(spark, d, "orders").agg(F.max(F.col("o_orderdate").cast("date"))).first()[0]
    day = F.lit(f"{last} 00:00:00Z").cast("timestamp")
    write(report(ruled(spark, d), "Album", day), path)
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", "exported string, name string, summary struct<key_findings:array<string>,recommendations:array<string>>").alias("x"))
    each = [docs.select(F.col("x.name").alias("album"), "x.exported", F.lit(kind).alias("kind"), F.posexplode(f"x.summary.{c}").alias("place", "text")) for kind, c in (("finding", "key_findings"), ("recommendation", "recommendations"))]
    return each[0].unionByName(each[1])


@query()
def q_pretty_json(spark, d):
    return A.summary(ruled(spark, d)).select("album", F.to_json(F.struct("*"), {"pretty": "true"}).alias("json"))
