"""Audio features of a media column.

``store`` writes each row's bytes, padded with zeros to a positive multiple of 64, as an 8-bit mono WAV (lossless: one
unsigned sample per byte). ``features`` reads the stored bytes back and computes, per row: samples resampled by a
polyphase filter; overlapped Hann frames of them through a mel filterbank, in dB; and segments in which the frame
energy is loud, with hysteresis. The filterbank output is cut into blocks of a fixed shape, an Arrow fixed-shape tensor
each, with the time span that a block covers. ``digests`` stores the features as a table and describes the tensors and spans that it reads back.
A long text is gone through in slices of frames, from samples to filterbank, so beside its bytes only the filterbank's output is held.

Null and empty texts are stored as 64 zero bytes. Repeated rows give repeated rows and equal bytes equal values; an empty table gives
an empty one; other columns are not read. A row is computed by itself, so its values don't depend on its neighbours.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ondine.llm._common import staged

RATE = 8000
#: The resampler multiplies the rate by UP and divides it by DOWN.
UP, DOWN, TAPS = 3, 4, 16
FRAME, HOP, BANDS, BLOCK_FRAMES = 256, 128, 20, 64
#: dB over the mean frame energy at which a segment starts, and under which it ends.
START_DB, END_DB = 0.5, -0.5
FLOOR = 1e-10
#: Frames that are made at a time.
SLICE = 4096
#: Bytes of media after which a batch of results is handed on.
BATCH_BYTES = 8 << 20


def payload(text: bytes | None) -> bytes:
    data = text or b""
    return data + bytes(-len(data) % 64 if data else 64)


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit mono PCM; ``samples`` is of even length, so that no chunk needs a pad byte."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def samples_of(media: bytes) -> tuple[bytes, int]:
    """The sample bytes and the rate of a WAV made by ``wav``; other chunks are passed over."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("no WAV")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("no 8-bit mono PCM")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@functools.lru_cache(maxsize=8)
def phases(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """One column for each of ``up`` outputs that ``down`` inputs give: a Kaiser-windowed sinc around the output's place.

    Its cut-off is half the lower of both rates; each column sums to 1.
    """
    bank = np.zeros((taps + down, up))
    for p in range(up):
        at, rest = divmod(p * down, up)
        arg = np.arange(taps) - (taps // 2 - 1) - rest / up
        h = np.sinc(arg * min(1, up / down)) * np.i0(6.0 * np.sqrt(np.maximum(0, 1 - (2 * arg / taps) ** 2)))
        bank[at : at + taps, p] = h / h.sum()
    return bank


def resample(x: np.ndarray, first: int = 0, last: int | None = None, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Outputs ``first`` to ``last`` (exclusive; all), zeros beyond the end. Output n stands at input n * down / up; all phases of a period are one
    matrix product with the inputs around it. ``x`` may be raw bytes, which become -1 to 1 here."""
    last = -(-len(x) * up // down) if last is None else last
    low, high = first // up, -(-last // up)
    a, b = low * down - (taps // 2 - 1), high * down + taps // 2 + 1
    held = x[max(a, 0) : max(b, 0)]
    held = (held.astype(np.float64) - 128) / 128 if held.dtype == np.uint8 else held
    padded = np.pad(held, (max(-a, 0), max(0, b - a - max(-a, 0) - len(held))))
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps + down)[::down][: high - low]
    out = (windows @ phases(up, down, taps)).ravel()[first - low * up : last - low * up]
    out[max(0, -(-len(x) * up // down) - first) :] = 0
    return out


@functools.lru_cache(maxsize=8)
def mel_bank(rate: float, frame: int = FRAME, bands: int = BANDS) -> np.ndarray:
    """Triangles spaced evenly in mel from 0 to half the rate, as (bins, bands)."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), bands + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    f = np.arange(frame // 2 + 1)[:, None] * rate / frame
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid)))


@functools.lru_cache(maxsize=4)
def hann(frame: int = FRAME) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / frame)


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(frames, bands) in dB of the resampled samples, as float32, and the frames' energies in dB; the end is padded with zeros to a whole frame.

    ``rate`` is the one after resampling. SLICE frames are made at a time.
    """
    n = -(-len(x) * UP // DOWN)
    frames = max(1, -(-(n - FRAME) // HOP) + 1)
    mel, energy = np.empty((frames, BANDS), np.float32), np.empty(frames)
    for k in range(0, frames, SLICE):
        count = min(SLICE, frames - k)
        y = resample(x, k * HOP, (k + count - 1) * HOP + FRAME)
        cut = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * hann()
        spectrum = np.fft.rfft(cut)
        mel[k : k + count] = 10 * np.log10(np.maximum((spectrum.real**2 + spectrum.imag**2) @ mel_bank(rate), FLOOR))
        energy[k : k + count] = (cut**2).mean(1)
    return mel, 10 * np.log10(np.maximum(energy, FLOOR))


def segments(energy: np.ndarray, start_db: float = START_DB, end_db: float = END_DB) -> list[tuple[int, int]]:
    """Frame ranges that begin above the mean plus ``start_db`` and last until below the mean plus ``end_db``."""
    over = energy - energy.mean()
    sign = np.where(over > start_db, 1, np.where(over < end_db, -1, 0))
    last = np.maximum.accumulate(np.where(sign != 0, np.arange(len(sign)), -1))
    on = np.concatenate([[0], np.where(last >= 0, sign[last] > 0, False), [0]]).astype(np.int8)
    edge = np.diff(on)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))


def analyse(samples: bytes, rate: int) -> tuple[np.ndarray, list[tuple[float, float]], float]:
    """Log-mel frames, segments as time spans in seconds, and the rate after resampling."""
    low = rate * UP / DOWN
    mel, energy = log_mel(np.frombuffer(samples, np.uint8), low)
    spans = [(a * HOP / low, ((b - 1) * HOP + FRAME) / low) for a, b in segments(energy)]
    return mel, spans, low


def blocks(mel: np.ndarray) -> np.ndarray:
    """(blocks, BLOCK_FRAMES, BANDS) as float32; the last block is filled up with the floor."""
    n = -(-len(mel) // BLOCK_FRAMES)
    if n * BLOCK_FRAMES == len(mel) and mel.dtype == np.float32:
        return mel.reshape(n, BLOCK_FRAMES, BANDS)
    full = np.full((n * BLOCK_FRAMES, BANDS), 10 * np.log10(FLOOR), np.float32)
    full[: len(mel)] = mel
    return full.reshape(n, BLOCK_FRAMES, BANDS)


def tensor_stream(mel: np.ndarray, rate: float) -> bytes:
    """Arrow IPC stream of ``start``, ``end`` (seconds) and ``mel``, a fixed-shape tensor for each block."""
    made = blocks(mel)
    start = np.arange(len(made)) * BLOCK_FRAMES * HOP / rate
    last = np.minimum((np.arange(len(made)) + 1) * BLOCK_FRAMES, len(mel)) - 1
    tensor = pa.FixedShapeTensorArray.from_numpy_ndarray(made)
    batch = pa.RecordBatch.from_arrays([pa.array(start), pa.array((last * HOP + FRAME) / rate), tensor], ["start", "end", "mel"])
    batch = batch.replace_schema_metadata({"rate": repr(float(rate))})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def stored_tensors(stream: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of a ``tensor_stream``, and the log-mel frames in them without what fills up the last block."""
    batch = pa.ipc.open_stream(stream).read_next_batch()
    made = batch.column("mel").to_numpy_ndarray()
    end = batch.column("end")[-1].as_py() * float(batch.schema.metadata[b"rate"])
    return made, made.reshape(-1, made.shape[2])[: round((end - FRAME) / HOP) + 1]


def described(tensors: bytes, spans: list[tuple[float, float]]) -> str:
    """Frames, segments, loud seconds, each band's mean over the tensors' frames to a tenth of a dB, and a digest of the tensors' values."""
    made, mel = stored_tensors(tensors)
    means = np.round(mel.mean(0, dtype=np.float64), 1) + 0.0
    head = f"frames={len(mel)};segments={len(spans)};loud={sum(b - a for a, b in spans):.2f};mel="
    return head + ",".join(f"{x:.1f}" for x in means) + f";tensors={hashlib.sha256(made.tobytes()).hexdigest()}"


def parcels(batch: pa.RecordBatch, column: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``rows`` rows, which close when the values of a binary column reach BATCH_BYTES."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, size in enumerate(sizes.tolist()):
        held += size
        if held >= BATCH_BYTES or i + 1 - start == rows:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < len(sizes):
        yield batch.slice(start)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored media table: id, ``n_bytes`` before padding, and ``media``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in parcels(batch, 1, 1000):
                raw = some.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(x or b"") for x in raw], pa.int64()), pa.array([wav(payload(x)) for x in raw], pa.binary())], ["id", "n_bytes", "media"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return staged(rows.mapInArrow(run, f"id {kind}, n_bytes bigint, media binary"), "media")


#: What ``features`` keeps of the media that it has read back.
READ_BACK = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string()}
READ_BACK_SQL = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string"


def features(media: DataFrame) -> DataFrame:
    """Per stored row: id, ``n_bytes``, sizes and digests of what is read back, ``tensors`` (see ``tensor_stream``) and ``spans`` of the loud segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))
        for batch in batches:
            for some in parcels(batch, 2, 200):
                read, tensors, spans = [], [], []
                for m in some.column(2):
                    data = m.as_py()
                    samples, rate = samples_of(data)
                    mel, loud, low = analyse(samples, rate)
                    read.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(data), hashlib.sha256(data).hexdigest()))
                    tensors.append(tensor_stream(mel, low))
                    spans.append([{"start": a, "end": b} for a, b in loud])
                columns = [pa.array([x[i] for x in read], t) for i, t in enumerate(READ_BACK.values())]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *columns, pa.array(tensors, pa.binary()), pa.array(spans, spans_type)], ["id", "n_bytes", *READ_BACK, "tensors", "spans"])

    kind = media.schema["id"].dataType.simpleString()
    return media.select("id", "n_bytes", "media").mapInArrow(run, f"id {kind}, n_bytes bigint, {READ_BACK_SQL}, tensors binary, spans array<struct<start: double, end: double>>")


def digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per stored row: sizes and digests of what is read back, and its stored features described in a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in parcels(batch, kept, 200):
                spans = [[(x["start"], x["end"]) for x in s.as_py()] for s in some.column(kept + 1)]
                made = [described(t.as_py(), s) for t, s in zip(some.column(kept), spans)]
                yield pa.RecordBatch.from_arrays([*some.columns[:kept], pa.array(made, pa.string())], ["id", "n_bytes", *READ_BACK, "feature"])

    kept = 2 + len(READ_BACK)
    rows = staged(features(media), "audio-features")
    kind = media.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, {READ_BACK_SQL}, feature string").withColumnRenamed("id", id_col)
