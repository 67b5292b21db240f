"""The catalog of metrics over records, and an album's findings in words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ondine.operators import album, catalog, metrics


def test_values_are_placed_against_their_bounds(spark):
    rows = spark.createDataFrame([(1, -14.0, 2.0, 3, 5.0), (2, float("-inf"), None, 0, None), (3, -8.0, 25.0, 0, float("nan"))], "track int, lufs double, lra double, clip_events int, width double")
    got = {(r.track, r.metric): (r.value, r.status) for r in metrics.placed(rows).collect()}
    assert len(got) == 12
    assert got[1, "lufs"] == (-14.0, "good") and got[2, "lufs"] == (None, "missing") and got[3, "lufs"] == (-8.0, "high")
    assert got[1, "lra"] == (2.0, "low") and got[2, "lra"] == (None, "missing") and got[3, "lra"] == (25.0, "high")
    assert got[1, "clip_events"] == (3.0, "high") and got[2, "clip_events"] == (0.0, "good")
    assert got[1, "width"] == (5.0, "unrated") and got[3, "width"] == (None, "missing")


def test_overview_has_every_metric(spark):
    rows = spark.createDataFrame([(1, -14.0), (2, -30.0)], "track int, lufs double")
    got = {r.metric: r for r in metrics.overview(rows).collect()}
    assert list(sorted(got)) == sorted(m.metric for m in metrics.METRICS)
    r = got["lufs"]
    assert (r.tracks, r.least, r["mean"], r.most, r.good, r.low, r.high) == (2, -30.0, -22.0, -14.0, 1, 1, 0)
    assert got["tilt"].tracks == 0 and got["tilt"].least is None
    assert metrics.overview(rows.limit(0)).count() == len(metrics.METRICS)


def test_the_catalog_is_searched_as_any_other(spark):
    rows = metrics.catalog(spark)
    score = catalog.relevance("peak", F.col("name"), category=F.col("category"), unit=F.col("unit"), description=F.col("description"))
    best = catalog.suggestions(rows, "peak", score, "ordinal").collect()
    assert [r.metric for r in best[:2]] == ["plr", "tp"] and len(best) == 6


def test_findings_in_words(spark):
    columns = "album string, avg_lufs double, above_peak bigint, with_clipping bigint, avg_dr double, with_phase bigint"
    rows = spark.createDataFrame([("a", -9.5, 2, 1, 5.0, 3), ("b", -14.0, 0, 0, 9.0, 0), ("c", None, 0, 0, None, 0), ("d", -18.0, 0, 0, 9.0, 0)], columns)
    got = {r.album: (r.f, r.k, r.r) for r in rows.select("album", album.findings().alias("f"), album.key_findings().alias("k"), album.recommendations().alias("r")).collect()}
    assert got["a"][0] == ["loud", "peaks", "clipping", "dynamics", "phase"] and got["a"][1][:2] == ["Album is very loud (avg -9.5 LUFS)", "2 track(s) exceed -1 dBTP true peak"] and len(got["a"][2]) == 5
    assert got["b"] == (["optimal"], ["Album loudness is in optimal range (avg -14.0 LUFS)"], [])
    assert got["c"] == ([], [], []) and got["d"][0] == ["quiet"] and len(got["d"][2]) == 1
