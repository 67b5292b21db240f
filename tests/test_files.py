"""WAV files: splits of any size, commits of tasks that fail, and from a folder to the reports of albums."""

from __future__ import annotations

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ondine.sources import wav


def file_of(frames: np.ndarray, rate: int, kind: int, bits: int, body: bytes, before: bytes = b"", size: int | None = None) -> bytes:
    channels = frames.shape[1]
    head = struct.pack("<4sI4s", b"RIFF", 0, b"WAVE") + before + struct.pack("<4sIHHIIHH", b"fmt ", 16, kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return head + struct.pack("<4sI", b"data", len(body) if size is None else size) + body


def test_splits_of_any_size_read_the_same(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = np.clip(rng.normal(size=(501, 2)), -1, 1)
    mono = x[:, :1]
    junk = struct.pack("<4sI", b"LIST", 3) + b"abc\0"  # a chunk of odd size is followed by a byte
    files = {
        "a16.wav": file_of(x, 8000, 1, 16, (x * 32767).astype("<i2").tobytes(), junk),
        "b24.wav": wav.encoded(x, 8000),
        "sub/c32f.WAV": file_of(mono, 100, 3, 32, mono.astype("<f4").tobytes() + b"\1\2"),
        "sub/d8.wav": file_of(x, 8000, 1, 8, (x * 127 + 128).astype(np.uint8).tobytes(), size=0xFFFFFFFF),
        "empty.wav": wav.encoded(x[:0], 8000),
        "broken.wav": b"RIFF....WAVE" + struct.pack("<4sI", b"data", 4) + b"1234",
        "none.wav": b"",
        "odd.wav": file_of(x, 8000, 1, 12, b"123"),
        "other.txt": b"no audio",
    }
    os.makedirs(tmp_path / "sub")
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    want = {}
    for split in (37, 1000, 1 << 20):
        rows = wav.read(spark, str(tmp_path), split).withColumn("name", F.element_at(F.split("path", "/"), -1)).collect()
        errors = {r.name: r.error for r in rows if r.error}
        assert errors == {"broken.wav": "data before fmt", "none.wav": "no RIFF/WAVE file", "odd.wav": "format 1 of 12 bits"}
        got = {}
        for r in sorted((r for r in rows if not r.error), key=lambda r: (r.name, r.start)):
            own = got.setdefault(r.name, [r.sample_rate, r.channels, r.bit_depth, []])
            assert r.start == len(own[3])
            own[3] += list(zip(r.l, r.r or r.l))
        assert {n: len(g[3]) for n, g in got.items()} == {"a16.wav": 501, "b24.wav": 501, "c32f.WAV": 501, "d8.wav": 501}
        want = want or got
        assert got == want
    assert np.allclose(want["c32f.WAV"][3], np.repeat(mono, 2, 1), atol=1e-7) and np.allclose(want["b24.wav"][3], x, atol=1e-6) and want["c32f.WAV"][:3] == [100, 1, 32]
    assert not wav.read(spark, str(tmp_path / "empty.wav")).collect()


def test_only_what_was_committed_stays(tmp_path):
    rows = [{"track": t, "block": b, "length": 4, "l": [0.5, -0.5], "r": [0.25, b / 2]} for t in ("a/b", "c") for b in (0, 1)]
    writer = wav.WavWriter({"path": str(tmp_path), "rate": "100"})

    def fails():
        yield from rows[:3]
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(fails())
    twice = [writer.write(iter(rows)), writer.write(iter(rows))]  # a task that ran twice: one of the two is committed
    writer.commit(twice[1:] + [None])
    assert sorted(os.listdir(tmp_path)) == ["a_b.wav", "c.wav"]
    kind, channels, rate, bits, raw = wav.header((tmp_path / "c.wav").read_bytes())
    assert (kind, channels, rate, bits) == (1, 2, 100, 24) and np.allclose(wav.decoded(kind, channels, bits, raw), [[0.5, 0.25], [-0.5, 0.0], [0.5, 0.25], [-0.5, 0.5]], atol=1e-6)
    again = wav.WavWriter({"path": str(tmp_path), "rate": "100"})
    again.write(iter(rows))
    again.abort([])
    assert sorted(os.listdir(tmp_path)) == ["a_b.wav", "c.wav"]


def test_from_a_folder_to_albums(spark, tmp_path):
    from ondine import analysis

    t = np.arange(8000) / 8000
    for album, name, gain in (("first", "1", 0.5), ("first", "2", 0.05), ("second", "1", 0.9)):
        os.makedirs(tmp_path / album, exist_ok=True)
        x = gain * np.sin(2 * np.pi * 440 * t)
        (tmp_path / album / f"{name}.wav").write_bytes(wav.encoded(np.stack([x, x], 1), 8000))
    (tmp_path / "second" / "2.wav").write_bytes(b"broken")
    records, albums = analysis.from_files(spark, str(tmp_path))
    got = {(r.album, r.track_number): r for r in records.collect()}
    assert set(got) == {("first", 1), ("first", 2), ("second", 1)}
    assert got["first", 1].sample_peak == pytest.approx(20 * np.log10(0.5), abs=1e-3) and got["first", 1].lufs - got["first", 2].lufs == pytest.approx(20, abs=0.01)
    assert {(r.sample_rate, r.bit_depth, r.channels, r.seconds) for r in got.values()} == {(8000, 24, 2, 1.0)}
    assert {r.album for r in albums.collect()} == {"first", "second"}


def test_a_report_file_for_each_album(spark, tmp_path):
    from ondine.sources import export

    reports = spark.createDataFrame([("A b", "a-b-analysis.json", '{"name":"é"}'), ("c", "c-analysis.json", "{}")], "album string, file string, json string").repartition(2)
    for _ in range(2):  # a second run replaces the first one's files
        export.write(reports, str(tmp_path / "out"))
    assert {p: (tmp_path / "out" / p).read_text() for p in os.listdir(tmp_path / "out")} == {"a-b-analysis.json": '{"name":"é"}', "c-analysis.json": "{}"}


def test_small_files_share_a_batch():
    import pyarrow as pa

    class Contents:
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: run

    contents = [b"no file"] * 700 + [wav.encoded(np.full((32, 2), k / 1000), 8000) for k in range(700)]
    batch = pa.RecordBatch.from_arrays([pa.array([f"{k}" for k in range(1400)]), pa.array(contents)], ["path", "content"])
    made = list(wav.parsed(Contents())(iter([batch])))
    assert [m.num_rows for m in made] == [1000, 400]
    rows = pa.Table.from_batches(made).to_pylist()
    assert [r["path"] for r in rows] == [f"{k}" for k in range(1400)] and rows[0]["error"] == "no RIFF/WAVE file" and rows[0]["l"] is None
    assert len(rows[1399]["l"]) == 32 and rows[1399]["r"][0] == pytest.approx(0.699, abs=1e-6) and rows[1399]["error"] is None


def test_a_row_of_a_file_is_a_batch(tmp_path):
    (tmp_path / "a.wav").write_bytes(wav.encoded(np.zeros((1000, 2)), 100))
    reader = wav.WavReader({"path": str(tmp_path), "rowFrames": "300"})
    made = [b for part in reader.partitions() for b in reader.read(part)]
    assert [(b.num_rows, len(b.column(6)[0])) for b in made] == [(1, 300), (1, 300), (1, 300), (1, 100)]


def test_batches_are_written_as_rows_are(tmp_path):
    import pyarrow as pa

    rows = [{"track": t, "block": b, "length": 4, "l": [0.5, -0.5], "r": [0.25, b / 2]} for t in ("a", "c") for b in (0, 1)]
    for name, given in (("rows", rows), ("batches", pa.Table.from_pylist(rows).to_batches(3))):
        writer = wav.WavWriter({"path": str(tmp_path / name), "rate": "100"})
        writer.commit([writer.write(iter(given))])
    for file in ("a.wav", "c.wav"):
        assert (tmp_path / "rows" / file).read_bytes() == (tmp_path / "batches" / file).read_bytes()
