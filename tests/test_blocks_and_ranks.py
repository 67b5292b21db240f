"""Ranks, searches by level and whole spectra against plain Python, with blocks and sketches so small that all of their ways are taken."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ondine import analysis
from ondine.operators import filters, following, loudness, ranks, stereo, whole_spectrum
from ondine.sources import synth


def test_ranks_of_groups_larger_than_the_sketch(spark):
    draw = random.Random(5)
    groups = {
        "even": [draw.random() for _ in range(20_000)],
        "ties": [float(draw.randrange(7)) for _ in range(9_000)],
        "one": [3.5] * 5_000,
        "steep": [math.exp(draw.uniform(-300, 300)) for _ in range(7_000)],
        "falling": [float(-i) for i in range(3_000)],
        "ends": [float("-inf")] * 900 + [float("inf")] * 900,
        "small": [2.0, 1.0],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("none", None)] * 3 + [("even", None)]
    made = spark.createDataFrame(rows, "g string, v double").repartition(7)
    wanted = {"low": ranks.at_share(0.10), "mid": ranks.at_share(0.5), "high": ranks.at_share_capped(0.95), "top": ranks.at_share_capped(1.0), "beyond": ranks.at_share(1.0), "worst": ranks.worst_percent()}
    got = {r.g: r for r in ranks.exact_ranks(made, ["g"], "v", accuracy=200, **wanted).collect()}
    assert set(got) == {*groups, "none"}
    for g, values in groups.items():
        s, n, r = sorted(values), len(values), got[g]
        assert r["size"] == n
        assert (r.low, r.mid, r.high, r.top) == (s[int(n * 0.10)], s[n // 2], s[min(int(n * 0.95), n - 1)], s[-1])
        assert r.beyond is None and r.worst == s[max(1, int(n * 0.01)) - 1]
    assert got["none"]["size"] == 0 and got["none"].mid is None and got["none"].top is None


def test_ranks_by_several_keys_and_of_nothing(spark):
    rows = spark.createDataFrame([(1, "a", 2.0), (1, "b", 5.0), (1, "a", 1.0)], "k int, c string, v double")
    got = {(r.k, r.c): r.m for r in ranks.exact_ranks(rows, ["k", "c"], "v", m=ranks.at_share(0.5)).collect()}
    assert got == {(1, "a"): 2.0, (1, "b"): 5.0}
    assert ranks.exact_ranks(rows.where("k > 1"), ["k"], "v", m=ranks.at_share(0.5)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 64, 65, 1000])
def test_search_in_an_array(n):
    draw = np.random.default_rng(n)
    x = draw.integers(0, 50, n).astype(float)
    after, level = draw.integers(-1, max(n, 1), 200), draw.integers(-2, 52, 200).astype(float)
    expected = [next((i for i in range(a + 1, n) if x[i] <= v), -1) for a, v in zip(after, level)]
    assert following.first_below(x, after, level).tolist() == expected


@pytest.mark.parametrize("block", [1, 7, 64, 1000])
def test_first_later_row_below_a_level(spark, block):
    draw = random.Random(block)
    series = {"a": [draw.gauss(0, 1) for _ in range(500)], "down": [float(-i) for i in range(130)], "flat": [1.0] * 70}
    events = [(t, draw.randrange(len(x)), draw.uniform(-3, 2)) for t, x in series.items() for _ in range(60)]
    events += [("a", 3, None), ("gone", 1, 0.0), ("a", 900, 0.0), ("flat", 5, 1.0), ("flat", 5, 1.0), ("down", 0, -129.0), ("a", 0, float("-inf")), ("flat", 69, 9.0)]
    rows = spark.createDataFrame([(t, i, v) for t, x in series.items() for i, v in enumerate(x)], "track string, n bigint, x double").repartition(5)
    asked = spark.createDataFrame(events, "track string, at bigint, level double")
    got = sorted(((r.track, r.at, r.level, r.found) for r in following.first_at_or_below(rows, asked, block).collect()), key=repr)

    def plain(t, at, level):
        x = series.get(t, [])
        return None if level is None else next((i for i in range(at + 1, len(x)) if x[i] <= level), None)

    assert got == sorted(((t, at, level, plain(t, at, level)) for t, at, level in set(events)), key=repr)


@pytest.mark.parametrize("cells", [1, 16, 64, 1 << 18])
def test_whole_spectra(spark, cells):
    draw = np.random.default_rng(3)
    tracks = {name: draw.normal(size=n) for name, n in {"a": 1000, "b": 1024, "c": 33, "d": 2, "e": 1, "f": 3}.items()}
    rows = spark.createDataFrame([(t, i, float(v)) for t, x in tracks.items() for i, v in enumerate(x)], "track string, n bigint, x double").repartition(3)
    got: dict[str, dict[int, float]] = {}
    for r in whole_spectrum.magnitudes(rows, cells).collect():
        assert got.setdefault(r.track, {}).setdefault(r.k, r.mag) == r.mag
    for t, x in tracks.items():
        size = 1 << max(0, len(x) - 1).bit_length()
        expected = np.abs(np.fft.rfft(x, size))[: size // 2]
        assert sorted(got.get(t, {})) == list(range(size // 2))
        assert np.allclose([got.get(t, {}).get(k) for k in range(size // 2)], expected) if size > 1 else t not in got


def test_spectrum_of_a_long_sine(spark):
    s = synth.stereo(spark, "lufs", 48_000, 1 << 17)
    made = whole_spectrum.magnitudes(s.select("track", "n", F.col("mono").alias("x")), 1 << 12)
    top = made.orderBy(F.desc("mag")).first()
    assert made.count() == 1 << 16 and abs(top.k * 48_000 / (1 << 17) - 1000) < 0.4


def test_whole_spectra_go_back_in_bounded_batches():
    import numpy as np
    import pyarrow as pa

    from ondine.operators import whole_spectrum as W

    rng = np.random.default_rng(5)
    signals = [rng.normal(size=1024) for _ in range(300)]
    whole = lambda v: pa.array([v] * len(signals), pa.int64())
    asked = pa.RecordBatch.from_arrays([pa.array([f"t{i}" for i in range(300)]), whole(32), whole(32), whole(0), pa.array([np.arange(1024)] * 300), pa.array(signals)], ["track", "a", "b", "group", "n", "x"])
    turned = list(W._columns(2048)(iter([asked])))
    assert len(turned) > 1 and max(len(t.column("re").values) for t in turned) <= W.BATCH
    nested = lambda c: pa.ListArray.from_arrays(list(range(len(c) + 1)), c)
    chunks = [pa.RecordBatch.from_arrays([*(t.column(c) for c in ("track", "a", "b", "rows")), nested(t.column("re")), nested(t.column("im"))], ["track", "a", "b", "rows", "re", "im"]) for t in turned]
    made = list(W._rows(2048)(iter([pa.Table.from_batches(chunks).combine_chunks().to_batches()[0]])))
    assert len(made) > 1 and max(m.num_rows for m in made) <= W.BATCH
    got = pa.Table.from_batches(made).to_pandas().sort_values(["track", "k"])
    for i in (0, 150, 299):
        assert np.allclose(got[got.track == f"t{i}"].mag, np.abs(np.fft.rfft(signals[i]))[:512])


def test_record_reads_its_samples_once(spark):
    """Filtered lows too are read from the blocks, of one block or of several, and not from the samples again."""
    rng = np.random.default_rng(7)
    rows = [(t, n, float(x), float(y)) for t, size in (("a", 5000), ("b", 12_345)) for n, (x, y) in enumerate(rng.uniform(-1, 1, (size, 2)).cumsum(0) / 50)]
    plain = spark.createDataFrame(rows, "track string, n bigint, l double, r double").repartition(3)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    signals = plain.mapInPandas(counted, plain.schema)
    got = {r.track: r for r in analysis.measured(signals, 1000, weigh=False, frame=64, block=5000).collect()}
    assert read.value == len(rows)
    wide = {r.track: r.width for r in stereo.band_width(plain, 1000, 20, 150).collect()}
    sub = {r.track: r for r in stereo.sub_bass(plain, 1000).collect()}
    assert set(got) == {"a", "b"}
    for track, r in got.items():
        assert r.low_width == pytest.approx(wide[track], rel=1e-9)
        assert (r.sub_ok, r.low_phase) == (sub[track].mono_compatible, sub[track].phase_issues)


def test_bands_and_peaks_by_blocks_read_their_samples_once(spark):
    """Of one block or of several, with gate blocks, windows and filters that stand across blocks."""
    rng = np.random.default_rng(11)
    rows = [(t, n, float(x), float(y)) for t, size in (("a", 4000), ("b", 9321)) for n, (x, y) in enumerate(np.clip(rng.normal(size=(size, 2)).cumsum(0) / 30, -1, 1))]
    plain = spark.createDataFrame(rows, "track string, n bigint, l double, r double").repartition(3)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    signals = plain.mapInPandas(counted, plain.schema)
    got = {(r.track, r.band): r.lufs for r in loudness.per_band(signals, 1000, size=3000).collect()}
    assert read.value == len(rows)
    chains = {"sub": (20, 80), "bass": (80, 250), "mid": (250, 475.0)}
    assert set(got) == {(t, b) for t in "ab" for b in chains}
    for band, (low, high) in chains.items():
        sections = filters.band_pass(low, high, 1000) + filters.k_weighting(1000)
        wide = filters.mapped(plain, {"a": ("l", sections), "b": ("r", sections)}).select("track", "n", F.col("a").alias("l"), F.col("b").alias("r"))
        for r in loudness.integrated(wide, 1000).collect():
            assert got[r.track, band] == pytest.approx(r.gated, rel=1e-9)

    before = read.value
    peaks = {r.track: r for r in loudness.peaks_and_loudness(signals, 1000, size=3000).collect()}
    assert read.value - before == len(rows)
    gated = {r.track: r.gated for r in loudness.integrated(plain, 1000).collect()}
    true = {r.track: r for r in loudness.true_peak(plain, "l", "r").collect()}
    tops = {r.track: r.top for r in loudness.windows(plain, 1000, 3).groupBy("track").agg(F.max("lufs").alias("top")).collect()}
    for t, r in peaks.items():
        assert (r.gated, r.true_peak_db, r.sample_peak_db, r.top) == pytest.approx((gated[t], true[t].true_peak_db, true[t].sample_peak_db, tops[t]), rel=1e-9)
    assert set(peaks) == {"a", "b"}
