"""WAV files as tables, and tables as WAV files.

``read`` takes files in splits, each a task's, and ``write`` commits one file for each track; both reach what Arrow's file systems reach. ``parsed``
takes contents of small files that are in a table already, as from Spark's binary source. Formats: PCM of 8, 16, 24 and 32 bits and IEEE floats of 32 and 64 bits. A file that is
broken gives one row with its ``error`` and no samples.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition

from ondine.operators.blocks import blocks
from ondine.sources.committed import CommittedWriter, Written, located

#: File names and MIME types that count as audio.
AUDIO_NAME = r"(?i)\.(wav|flac|aiff|aif|mp3|m4a|aac|ogg)$"
SCHEMA = "path string, sample_rate int, channels int, bit_depth int, format int, chunk int, l array<float>, r array<float>, error string"


def is_audio(path: Column, mime: Column | None = None) -> Column:
    named = F.rlike(path, F.lit(AUDIO_NAME))
    return named if mime is None else named | F.coalesce(F.startswith(mime, F.lit("audio/")), F.lit(False))


def numbered(files: DataFrame, album: str = "album", name: str = "name") -> DataFrame:
    """Track numbers from 1 in the order of the names, by Unicode collation."""
    order = Window.partitionBy(album).orderBy(F.collate(F.col(name), "UNICODE"), name)
    return files.withColumn("track_number", F.row_number().over(order))


def files(spark: SparkSession, path: str) -> DataFrame:
    """Audio files under a folder: album (their folder), name, length and track number; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where(is_audio(F.col("path")))
    parts = F.split("path", "/")
    return numbered(found.select("path", F.element_at(parts, -2).alias("album"), F.element_at(parts, -1).alias("name"), "length"))


def header(data: bytes) -> tuple[int, int, int, int, bytes]:
    """Format, channels, rate, bits and the sample bytes."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    at, fmt = 12, None
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if kind == 0xFFFE and size >= 26:
                kind = struct.unpack_from("<H", data, at + 32)[0]
            fmt = (kind, channels, rate, bits)
        elif name == b"data":
            if fmt is None:
                raise ValueError("data before fmt")
            return (*fmt, data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def decoded(kind: int, channels: int, bits: int, raw: bytes) -> np.ndarray:
    """(frames, channels) as float32 in [-1, 1]."""
    wide = bits // 8
    raw = raw[: len(raw) // (wide * channels) * wide * channels]
    if kind == 1 and bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128
    elif kind == 1 and bits == 16:
        x = np.frombuffer(raw, "<i2") / 32768
    elif kind == 1 and bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        padded = np.zeros((len(b), 4), np.uint8)
        padded[:, 1:] = b
        x = (padded.view("<i4").ravel() >> 8) / 8388608
    elif kind == 1 and bits == 32:
        x = np.frombuffer(raw, "<i4") / 2147483648
    elif kind == 3 and bits in (32, 64):
        x = np.frombuffer(raw, "<f4" if bits == 32 else "<f8")
    else:
        raise ValueError(f"format {kind} of {bits} bits")
    return x.reshape(-1, channels).astype(np.float32)


def header_of(frames: int, channels: int, rate: int) -> bytes:
    """Header of a file of 24-bit PCM."""
    size = frames * channels * 3
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", min(36 + size, 0xFFFFFFFF), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * channels * 3, channels * 3, 24, b"data", min(size, 0xFFFFFFFF))


def body_of(frames: np.ndarray) -> bytes:
    """24-bit PCM of (frames, channels), clipped to [-1, 1]."""
    x = np.floor(np.clip(frames, -1, 1) * 8388607 + 0.5).astype("<i4").reshape(-1, 1)
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def encoded(frames: np.ndarray, rate: int) -> bytes:
    """A whole file of 24-bit PCM."""
    return header_of(*frames.shape, rate) + body_of(frames)


def parsed(contents: DataFrame) -> DataFrame:
    """Of (path, content): chunks of a second; a mono file has no right channel."""

    names, kinds = [c.split()[0] for c in SCHEMA.split(", ")], [ARROW[c.split()[1]] for c in SCHEMA.split(", ")]
    packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                path = batch.column(0)[i].as_py()
                try:
                    kind, channels, rate, bits, raw = header(batch.column(1)[i].as_py())
                    x = decoded(kind, channels, bits, raw)
                except (ValueError, struct.error) as e:
                    rows.append((path, None, None, None, None, 0, None, None, str(e)))
                else:
                    step = max(1, rate)
                    rows += [(path, rate, channels, bits, kind, k // step, x[k : k + step, 0], x[k : k + step, 1] if channels > 1 else None, None) for k in range(0, max(1, len(x)), step)]
                    held += x.size
                if held >= FRAMES or len(rows) >= 1000:
                    yield packed(rows)
                    rows, held = [], 0
        if rows:
            yield packed(rows)

    return contents.select("path", "content").mapInArrow(run, SCHEMA)


#: Bytes of a file that one task reads, and frames of a row that comes of them.
SPLIT, FRAMES = 32 << 20, 1 << 16
#: Arrow's types of the columns.
ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "array<float>": pa.list_(pa.float32())}
FILE_SCHEMA = "path string, sample_rate int, channels int, bit_depth int, format int, start bigint, l array<float>, r array<float>, error string"


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


def located_data(file) -> tuple[int, int, int, int, int, int]:
    """Format, channels, rate, bits, and where the sample bytes start and end, from the heads of a file's chunks alone."""
    total, at, fmt = file.size(), 12, None
    head = file.read_at(12, 0)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    while at + 8 <= total:
        name, size = struct.unpack("<4sI", file.read_at(8, at))
        if name == b"data":
            if fmt is None:
                raise ValueError("data before fmt")
            # a size that overflowed, or was never set, means the rest of the file
            return (*fmt, at + 8, total if size in (0, 0xFFFFFFFF) else min(total, at + 8 + size))
        if name == b"fmt ":
            own = file.read_at(min(size, 40), at + 8)
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", own)
            if kind == 0xFFFE and size >= 26:
                kind = struct.unpack_from("<H", own, 24)[0]
            fmt = (kind, channels, rate, bits)
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


class WavReader(DataSourceReader):
    """Files in splits of bytes: a task reads the head of its file and the frames that start in its split. The driver lists names and sizes alone.

    A file that is broken gives one row with its ``error``; one without samples gives none.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split, self.frames = options["path"], int(options.get("splitBytes", SPLIT)), int(options.get("rowFrames", FRAMES))

    def partitions(self) -> list[Split]:
        store, where = located(self.path)
        root = self.path[: len(self.path) - len(where)] if self.path.endswith(where) else ""
        one = store.get_file_info(where)
        found = [one] if one.is_file else store.get_file_info(fs.FileSelector(where, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.lower().endswith((".wav", ".wave")) and "/_temporary/" not in f.path)
        return [Split(root + name, k, min(size, k + self.split)) for name, size in files for k in range(0, max(1, size), self.split)] or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        """A batch for each row: Spark would gather thousands of rows before it sent one on."""
        names, kinds = [c.split()[0] for c in FILE_SCHEMA.split(", ")], [ARROW[c.split()[1]] for c in FILE_SCHEMA.split(", ")]
        for row in self._rows(partition):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names)

    def _rows(self, partition: Split) -> Iterator[tuple]:
        if not partition.path:
            return
        store, where = located(partition.path)
        with store.open_input_file(where) as file:
            try:
                kind, channels, rate, bits, begin, end = located_data(file)
                wide = bits // 8 * channels
                decoded(kind, channels, bits, b"")
            except (ValueError, struct.error) as e:
                if partition.start == 0:
                    yield (partition.path, None, None, None, None, 0, None, None, str(e))
                return
            first = max(0, -(-(partition.start - begin) // wide))
            last = min((end - begin) // wide, max(0, -(-(partition.end - begin) // wide)))
            for k in range(first, last, self.frames):
                x = decoded(kind, channels, bits, file.read_at((min(last, k + self.frames) - k) * wide, begin + k * wide))
                yield (partition.path, rate, channels, bits, kind, k, x[:, 0], x[:, 1] if channels > 1 else None, None)


class WavWriter(CommittedWriter, DataSourceArrowWriter):
    """One file for each track from rows (track, block, length, l, r) or batches of them, which come to a task by track and in order of block."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.rate = int(options["rate"])

    def write(self, iterator: Iterator) -> Written:
        store, waiting = located(self.waiting)
        store.create_dir(waiting, recursive=True)
        done, file, name = [], None, None
        try:
            for row in self._rows(iterator):
                if row["track"] != name:
                    if file:
                        file.close()
                    name = row["track"]
                    at = f"{waiting}/{uuid.uuid4().hex}"
                    file = store.open_output_stream(at)
                    file.write(header_of(row["length"], 2, self.rate))
                    done.append((at, f"{re.sub(r'[^A-Za-z0-9_.-]', '_', str(name))}.wav"))
                file.write(body_of(np.stack([np.asarray(row["l"], np.float64), np.asarray(row["r"], np.float64)], 1)))
        finally:
            if file:
                file.close()
        return Written(done)

    @staticmethod
    def _rows(iterator: Iterator) -> Iterator:
        for item in iterator:
            if not isinstance(item, pa.RecordBatch):
                yield item
                continue
            for i in range(item.num_rows):
                row = {c: item.column(c)[i] for c in ("track", "length", "l", "r")}
                yield {c: row[c].as_py() for c in ("track", "length")} | {c: row[c].values.to_numpy(zero_copy_only=False) for c in ("l", "r")}


class WavSource(DataSource):
    """``spark.read.format("wav").load(path)`` and ``df.write.format("wav").option("rate", r).save(path)``, once registered."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return FILE_SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WavWriter:
        return WavWriter(dict(self.options))


def read(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The files under ``path``, or one, in rows of at most FRAMES frames: FILE_SCHEMA."""
    spark.dataSource.register(WavSource)
    return spark.read.format("wav").option("splitBytes", split).load(path)


def write(signals: DataFrame, path: str, rate: int, block: int = FRAMES) -> None:
    """Each track of (track, n, l, r) as a WAV file in the folder ``path``. A track's blocks stream through the task that writes its file,
    which holds one at a time; names keep letters, digits, and ``_.-``."""
    signals.sparkSession.dataSource.register(WavSource)
    laid = blocks(signals, 0, block)
    lengths = signals.groupBy("track").agg(F.count("*").alias("length"))
    rows = laid.join(lengths, "track").select(F.col("track").cast("string").alias("track"), "block", "length", "l", "r")
    rows.repartition("track").sortWithinPartitions("track", "block").write.format("wav").option("rate", rate).mode("append").save(path)


def samples(chunks: DataFrame) -> DataFrame:
    """Long form (track, n, l, r, mono); the right channel of a mono file is its left."""
    start = F.col("start") if "start" in chunks.columns else F.col("chunk").cast("bigint") * F.col("sample_rate")
    rows = chunks.where("error is null").select(F.col("path").alias("track"), start.alias("start"), F.posexplode(F.arrays_zip("l", F.coalesce("r", "l").alias("r"))).alias("i", "x"))
    made = rows.select("track", (F.col("start") + F.col("i")).alias("n"), F.col("x.l").cast("double").alias("l"), F.col("x.r").cast("double").alias("r"))
    return made.withColumn("mono", (F.col("l") + F.col("r")) / 2)
