"""Closed-form signals measure as they must."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ondine.functions import scalar as X
from ondine.operators import dynamics, filters, loudness, spectral, stereo
from ondine.sources import synth, wav

RATE = 48_000


@pytest.fixture(scope="module")
def sine(spark):
    """Sine of 1 kHz, 2 s, at the amplitude of -14 LUFS."""
    return synth.stereo(spark, "lufs", RATE, RATE * 2).cache()


def one(df):
    return df.collect()[0]


def test_sine_levels(sine):
    r = one(dynamics.basic_stats(sine))
    assert r.peak_db == pytest.approx(-10.299, abs=0.01) and r.crest_db == pytest.approx(3.010, abs=0.01) and abs(r.dc) < 1e-9


def test_integrated_loudness_of_two_equal_channels(sine):
    weighted = loudness.weighted(sine, RATE)
    r = one(loudness.integrated(weighted, RATE))
    assert r.gated == pytest.approx(-10.292, abs=0.1)
    windows = loudness.windows(weighted, RATE, 0.4).agg(F.count("*").alias("n"), F.max("lufs").alias("top")).first()
    assert windows.n == 17 and windows.top == pytest.approx(-10.29, abs=0.1)


def test_true_peak_of_alternating_samples_is_below_them(spark):
    r = one(loudness.true_peak(synth.stereo(spark, "alternating", RATE, 2000), "l", "r"))
    assert r.sample_peak_db == 0.0 and r.true_peak_db == pytest.approx(-0.791, abs=0.01)


def test_short_track_has_its_sample_peak(spark):
    rows = spark.createDataFrame([("t", i, 0.5, 0.25, 0.375) for i in range(10)], "track string, n bigint, l double, r double, mono double")
    r = one(loudness.true_peak(rows, "l", "r"))
    assert r.true_peak_db == r.sample_peak_db == pytest.approx(20 * np.log10(0.5))


def test_silence(spark):
    s = synth.stereo(spark, "silence", 1000, 3500)
    assert one(dynamics.basic_stats(s)).peak_db == float("-inf")
    assert one(loudness.integrated(s, 1000)).gated == float("-inf")
    edges = one(dynamics.silence_edges(s, 1000))
    assert (edges.start_ms, edges.end_ms) == (3500, 3500)
    assert one(dynamics.noise_floor(s)).noise_floor_db == float("inf")
    assert loudness.loudness_range(loudness.windows(s, 1000, 3)).count() == 0


def test_inverted_channel(spark):
    s = synth.stereo(spark, "sine", 8000, 8000, right=-1.0)
    assert one(stereo.correlation(s)).correlation == pytest.approx(-1.0)
    assert one(stereo.width(s)).width == 0.0
    assert one(stereo.windowed_stats(s, 1600, 8000)).mean == pytest.approx(-1.0)


def test_clipping_and_offset(spark):
    r = one(dynamics.clip_events(synth.stereo(spark, "clipped", 48_000, 48_000), 48_000))
    assert r.events == 4000 and r.clipped > 20_000
    assert one(dynamics.basic_stats(synth.stereo(spark, "dc", 8000, 8000))).dc == pytest.approx(0.1, abs=1e-3)


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 1000])
def test_block_recurrence_equals_the_plain_one(n):
    x = np.random.default_rng(n).normal(size=n)
    b, a = filters.SHELF
    y = np.zeros(n)
    for i in range(n):
        y[i] = sum(b[k] * x[i - k] for k in range(3) if i >= k) - sum(a[k] * y[i - k] for k in (1, 2) if i >= k)
    assert np.abs(filters.iir(x, b, a) - y).max() < 1e-9


def test_wav_formats(spark):
    x = np.random.default_rng(1).uniform(-1, 1, (3000, 2))
    made = wav.samples(wav.parsed(spark.createDataFrame([("a", wav.encoded(x, 1000))], "path string, content binary"))).orderBy("n").collect()
    assert len(made) == 3000 and np.abs(np.array([(r.l, r.r) for r in made]) - x).max() < 1e-6
    bad = {r.path: r.error for r in wav.parsed(spark.createDataFrame([("e", b""), ("n", b"RIFF0000WAVEdata\0\0\0\0")], "path string, content binary")).collect()}
    assert bad["e"] == "no RIFF/WAVE file" and bad["n"] == "data before fmt"


def test_spectrum_and_distortion(spark):
    frames = spark.createDataFrame([(1, k, np.sin(2 * np.pi * 8 * np.arange(64) / 64).tolist()) for k in range(3)], "track int, frame int, x array<double>")
    bins = spectral.bins(frames, 6400, 64)
    assert bins.orderBy(F.desc("mag")).first().k == 8
    r = one(spectral.distortion_summary(spectral.distortion(bins, 6400, 64), 6400, 64))
    assert r.fundamental_hz == 800 and r.character == "clean"


def test_guards(spark):
    row = spark.range(1).select(X.db_from_linear(F.lit(0.0)).alias("zero"), X.db_from_linear(F.lit(float("nan"))).alias("nan"), X.upper_median(F.array(F.lit(1.0), F.lit(2.0))).alias("m"), X.next_power_of_2(F.lit(65)).alias("p"), X.duration_text(F.lit(3661.9)).alias("t"), X.pitch_class(F.lit(440.0)).alias("a")).first()
    assert row.zero == row.nan == float("-inf") and row.m == 2.0 and row.p == 128 and row.t == "1:01:01" and row.a == 9


def test_blocks_of_a_track_agree_with_the_whole(spark):
    """Tracks of many blocks, of one, and of less than a section's memory; all chains at once."""
    rng = np.random.default_rng(5)
    tracks = {"a": rng.normal(size=1000), "b": rng.normal(size=300), "c": rng.normal(size=299), "d": np.ones(1), "e": np.ones(2)}
    df = spark.createDataFrame([(t, n, float(v), float(-v)) for t, x in tracks.items() for n, v in enumerate(x)], "track string, n bigint, x double, z double")
    chains = {"k": filters.k_weighting(48000), "bp": filters.band_pass(100, 5000, 48000), "both": filters.band_pass(20, 80, 48000) + filters.k_weighting(44100), "hp": filters.high_pass(300, 48000)}
    kernels = {name: ("z" if name == "bp" else "x", chain) for name, chain in chains.items()}
    got = {(r.track, r.n): r for r in filters.mapped(df, kernels, size=100).collect()}
    assert len(got) == sum(map(len, tracks.values()))
    for t, x in tracks.items():
        for name, chain in chains.items():
            y = -x if name == "bp" else x
            for b, a in chain:
                out = []
                for n in range(len(y)):
                    out.append(sum(c * y[n - k] for k, c in enumerate(b) if n >= k) - sum(c * out[n - k] for k, c in enumerate(a) if k and n >= k))
                y = np.array(out)
            assert max(abs(got[t, n][name] - y[n]) for n in range(len(x))) < 1e-9


def test_true_peak_in_blocks(spark):
    rng = np.random.default_rng(6)
    tracks = {"a": rng.normal(size=100), "b": rng.normal(size=25), "c": rng.normal(size=11), "d": rng.normal(size=12), "e": rng.normal(size=13)}
    df = spark.createDataFrame([(t, n, float(v)) for t, x in tracks.items() for n, v in enumerate(x)], "track string, n bigint, x double")
    want = {r.track: r.true_peak_db for r in loudness.true_peak(df, "x").collect()}
    for block in (12, 13, 25, 50):
        assert {r.track: r.true_peak_db for r in loudness.true_peak(df, "x", block=block).collect()} == want
    for t, x in tracks.items():
        level = max((abs(sum(p[k] * x[n - k] for k in range(12))) for n in range(11, len(x)) for p in loudness.PHASES), default=max(abs(x)))
        assert want[t] == pytest.approx(20 * np.log10(level), abs=1e-9)


def test_a_sine_has_its_record(spark, sine):
    """All operators together on a signal of known measures; two equal channels of 1 kHz at an amplitude of 0.3055 measure -10.29 LUFS."""
    from ondine import analysis

    (r,) = analysis.track_record(sine, RATE).collect()
    assert r.lufs == pytest.approx(-10.29, abs=0.05) and r.tp == pytest.approx(-10.29, abs=0.05) and r.crest == pytest.approx(3.01, abs=0.01)
    assert r.corr == pytest.approx(1) and r.plr == pytest.approx(r.tp - r.lufs) and not r.clipped and not r.true_stereo and r.seconds == 2
    assert [w.code for w in r.warnings if w.code == "dual_mono"] and not r.issues
    (a,) = analysis.album_report(analysis.numbered(analysis.track_record(sine, RATE), sine.select("track", F.lit("x").alias("album")).distinct())).collect()
    assert a.tracks == 1 and a.avg_lufs == pytest.approx(r.lufs, abs=0.06) and a.ready and a.worst_jump == 0
    assert analysis.track_record(sine.limit(0), RATE).count() == 0


def test_low_pass_of_a_stream_is_in_order_of_time(spark, tmp_path):
    """Samples that come in a later file with an earlier time are filtered in their place; the last ones are held."""
    import datetime as dt
    import time

    from ondine.streaming import live

    start = dt.datetime(2024, 1, 1)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2, 60))
    rows = [(t, start + dt.timedelta(seconds=int(n)), int(n), float(x[t, n])) for t in range(2) for n in range(60)]
    parts = [[r for r in rows if r[2] < 20 and r[2] % 3], [r for r in rows if r[2] < 20 and not r[2] % 3 or 20 <= r[2] < 40], [r for r in rows if r[2] >= 40]]
    schema = "track bigint, ts timestamp, n bigint, x double"
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    found = live.folded(stream, "25 seconds", live.LowPass("bigint", 100, 1000))
    running = found.writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet").start(f"{tmp_path}/out")
    running.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {(r.track, r.n): r.y for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert set(got) == {(t, n) for t in range(2) for n in range(59 - 25)}
    a = np.exp(-2 * np.pi * 100 / 1000)
    for t in range(2):
        y = 0.0
        for n in range(59 - 25):
            y = (1 - a) * x[t, n] + a * y
            assert got[t, n] == pytest.approx(y, abs=1e-12)


def test_fixed_decimals(spark):
    from ondine.functions.scalar import fixed

    values = [0.125, 0.375, -0.125, 1.005, 2.675, 1e9 + 0.005, 0.0, 8.345]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed(F.col("v"), 2).alias("t"))
    assert {r.v: r.t for r in df.collect()} == {0.125: "0.13", 0.375: "0.38", -0.125: "-0.13", 1.005: "1.00", 2.675: "2.67", 1e9 + 0.005: "1000000000.00", 0.0: "0.00", 8.345: "8.35"}


def test_band_level(spark):
    # a sine of 11,025 Hz and amplitude 0.5 at 44,100 Hz stands in one bin of 64; the last 10 samples make no whole frame
    tone = spark.range(64 * 5 + 10).selectExpr("'a' as track", "id as n", "0.5 * sin(pi() * id / 2) as mono")
    frames = spectral.whole_frames(tone, 64)
    assert frames.count() == 5
    spectra = spectral.bins(frames, 44100, 64)
    (inside,), (outside,) = spectral.band_level(spectra, 8000, 16000, 64).collect(), spectral.band_level(spectra, 100, 5000, 64).collect()
    assert abs(inside["level_db"] - 20 * np.log10(0.5 / np.sqrt(2))) < 0.1 and outside["level_db"] < -40
    assert spectral.band_level(spectral.bins(spectral.whole_frames(tone.limit(0), 64), 44100, 64), 8000, 16000, 64).count() == 0


def test_any_cutting_into_blocks_gives_the_same_record(spark):
    """Blocks of a few samples and of all of them; clipped runs, silence and frames that stand across blocks."""
    from ondine import analysis
    from ondine.operators import blocks

    rng = np.random.default_rng(9)
    rows = []
    for track, n in (("a", 5000), ("b", 777), ("c", 11), ("d", 1)):
        x = np.clip(rng.normal(size=(n, 2)) * rng.choice([0.0, 0.3, 2.0], size=(n // 50 + 1, 1)).repeat(50, 0)[:n], -1, 1)
        rows += [(track, i, float(a), float(b)) for i, (a, b) in enumerate(x)]
    signals = spark.createDataFrame(rows, "track string, n bigint, l double, r double").repartition(3).cache()
    want = None
    for size in (100_000, 1000, 333):
        made = blocks.parts(signals, 1000, blocks.record_kinds(1000), 64, 44100, size)
        tracks = {r.track: {c: round(v, 9) if isinstance(v, float) else sorted(v) if c == "strided" else v for c, v in r.asDict().items()} for r in blocks.merged(made).collect()}
        kinds = {k: sorted((r.track, r.frame, tuple(round(v, 9) for v in r[2:])) for r in blocks.frames_of(made, k, *"abcde"[: {"corr": 5, "crest": 2}.get(k, 1)]).collect()) for k in blocks.record_kinds(1000)}
        sums = sorted((r.track, r.hop, r["size"], round(r.p, 9)) for r in blocks.hops_of(made).collect())
        spectrum = sorted((r.track, r.k, round(r.mag, 6), round(r.square, 6), r.frames) for r in blocks.spectrum_of(made, 1.0).collect())
        want = want or (tracks, kinds, sums, spectrum)
        assert (tracks, kinds, sums, spectrum) == want
    assert tracks["a"]["n"] == 5000 and tracks["a"]["clip_events"] > 5 and len(kinds["gate"]) > 10
    for track in "ab":
        x = np.array([r[2:] for r in rows if r[0] == track])
        hit = np.abs(x) >= 0.9999
        starts = (hit & ~np.vstack([[False, False], hit[:-1]])).sum()
        assert (tracks[track]["clip_events"], tracks[track]["clipped"]) == (starts, hit.sum())
    record = {r.track: r for r in analysis.measured(signals, 1000, weigh=False, bands=False, frame=64, heard_at=44100, block=333).collect()}
    other = {r.track: r for r in analysis.measured(signals, 1000, weigh=False, bands=False, frame=64, heard_at=44100).collect()}
    assert set(record) == {"a", "b", "c", "d"}
    for t, r in record.items():
        for c in r.__fields__:
            assert r[c] == other[t][c] or r[c] == pytest.approx(other[t][c], rel=1e-9, abs=1e-9), (t, c)
    assert not blocks.parts(signals.limit(0), 1000, blocks.record_kinds(1000), 64).collect()


def test_autocorrelation_in_stretches(spark):
    from ondine.operators import musical

    rng = np.random.default_rng(3)
    data = {"a": rng.random(400), "b": rng.random(35), "c": rng.random(7)}
    envelope = spark.createDataFrame([(t, i, float(e)) for t, v in data.items() for i, e in enumerate(v)], "track string, i bigint, e double").repartition(3)
    for stretch in (50, 1 << 14):
        got = {(r.track, r.lag): r.r for r in musical.autocorrelation(envelope, 5, 60, stretch).collect()}
        assert set(got) == {(t, k) for t, v in data.items() for k in range(5, 61) if k < len(v)}
        assert all(r == pytest.approx(np.mean(data[t][:-k] * data[t][k:])) for (t, k), r in got.items())


def test_variation_on_a_bound_is_that_of_the_sql(spark):
    """Two gaps of 3 to 7 vary by 0.4, a bound of the characters, where the last bit decides."""
    import duckdb

    from ondine.plans.dynamics import SPACING

    pairs = [(a, b) for a in range(10, 110) for b in range(10, 110) if a + b < 120 and any(abs(abs(a - b) / (a + b) - t) < 1e-12 for t in (0.08, 0.18, 0.4))]
    onsets = [(t, i) for t, (a, b) in enumerate(pairs) for i in (3, 3 + a, 3 + a + b)] + [(len(pairs), 5)]
    con = duckdb.connect()
    con.execute("create table ons (track bigint, i bigint)")
    con.executemany("insert into ons values (?, ?)", onsets)
    con.execute(f"create table short as select track, n from range({len(pairs) + 2}) a(track), range(600) b(n)")
    want = con.sql(f"with {SPACING.replace('{0}', 'short')} select track, onsets, cv, case when onsets < 3 then 'natural' when cv < 0.08 then 'robotic' when cv < 0.18 then 'tight' when cv < 0.4 then 'natural' else 'loose' end as character from sp").fetchall()
    sizes = spark.createDataFrame([(t, 600) for t in range(len(pairs) + 2)], "track bigint, length bigint")
    got = dynamics.spacing(spark.createDataFrame(onsets, "track bigint, i bigint").repartition(7), sizes, 5, 1000)
    assert sorted(tuple(r) for r in got.select("track", "onsets", "cv", "character").collect()) == sorted(want)


def test_exact_mean_in_any_order(spark):
    import math
    import random

    up = [(q - 25.5) / 24.5 for q in range(1, 51)] * 12
    values = {1: up, 2: [1.0, 2.0**-80, -1.0], 3: [-0.1] * 7 + [0.7], 4: [1 / 3] * 1000, 5: [-1.5, None]}
    rows = [(k, x) for k, v in values.items() for x in v]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = dict(spark.createDataFrame(rows, "k int, x double").repartition(5).groupBy("k").agg(X.exact_avg(F.col("x"))).collect())
        assert got == {k: math.fsum(x for x in v if x is not None) / sum(x is not None for x in v) for k, v in values.items()}


def test_tracks_of_a_bucket_share_its_calls_to_the_state():
    import pandas as pd

    from ondine.streaming import live

    class Handle:
        calls, timers, value = 0, set(), None
        getValueState = lambda self, name, kind: self
        registerTimer = lambda self, at: self.timers.add(at)
        deleteTimer = lambda self, at: self.timers.discard(at)
        get = lambda self: self.update(self.value)

        def update(self, value):
            self.calls, self.value = self.calls + 1, value
            return value

        def clear(self):
            self.value = None

    class Watermark:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    rng = np.random.default_rng(2)
    us = rng.permutation(20_000) * 1000
    rows = pd.DataFrame({"track": np.arange(20_000) % 100, "us": us, "n": us // 1000, "x": rng.normal(size=20_000)})
    for processor, want in ((live.LowPass("bigint", 100, 1000), None), (live.Onsets("bigint", 0.5, 1_000_000), None)):
        handle, got = Handle(), []
        handle.timers = set()
        processor.init(handle)
        processor.idle_ms = 5
        for low, high, passed in ((0, 6, 5_000), (6, 13, 12_000), (13, 20, 19_000), (20, 21, 40_000)):
            some = rows[(rows.us >= low * 1_000_000) & (rows.us < high * 1_000_000)]
            if len(some):
                list(processor.handleInputRows((7,), iter([some[: len(some) // 2], some[len(some) // 2 :]]), Watermark(passed - 1000)))
            assert len(handle.timers) == 1
            handle.timers.clear()
            got += list(processor.handleExpiredTimer((7,), Watermark(passed), None))
        assert handle.calls < 20 and handle.value is None and not handle.timers
        got = pd.concat(got)
        for track in (0, 42, 99):
            own = rows[rows.track == track].sort_values("us")
            alone = np.empty(len(own), live.WAITING)
            alone["ts"], alone["n"], alone["x"] = own.us, own.n, own.x
            want = processor.fold(None, alone, True)[1]
            mine = got[got.track == track]
            assert all(np.allclose(mine[c].to_numpy(np.float64), np.asarray(want[c], np.float64)) for c in want)
