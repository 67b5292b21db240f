"""The signal operators on streams: event-time windows, sessions, and recurrences that keep state."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ondine.functions.scalar import lufs_from_power
from ondine.operators.filters import iir


def loudness(stream: DataFrame, width: str, slide: str, late: str) -> DataFrame:
    """Loudness of sliding windows of (track, ts, x); samples that come more than ``late`` behind are left out."""
    windows = stream.withWatermark("ts", late).groupBy("track", F.window("ts", width, slide))
    made = windows.agg(F.count("*").alias("samples"), F.avg(F.col("x") * F.col("x")).alias("p"))
    return made.select("track", F.col("window.start").alias("start"), "samples", lufs_from_power(F.col("p")).alias("lufs"))


def tumbling_energy(stream: DataFrame, width: str, late: str) -> DataFrame:
    made = stream.withWatermark("ts", late).groupBy("track", F.window("ts", width)).agg(F.count("*").alias("samples"), F.sum(F.col("x") * F.col("x")).alias("energy"))
    return made.select("track", F.col("window.start").alias("start"), "samples", "energy")


def loud_sessions(stream: DataFrame, least: float, gap: str, late: str) -> DataFrame:
    """Runs of loud samples that are nowhere ``gap`` apart."""
    loud = stream.where(F.abs("x") >= least).withWatermark("ts", late)
    made = loud.groupBy("track", F.session_window("ts", gap)).agg(F.count("*").alias("samples"), F.max(F.abs("x")).alias("peak"))
    return made.select("track", F.col("session_window.start").alias("start"), "samples", "peak")


#: A sample that waits for its turn.
WAITING = np.dtype([("ts", "i8"), ("n", "i8"), ("x", "f8")])


class Bucketed(StatefulProcessor):
    """State of the tracks of a bucket under one key: a call to the state store costs milliseconds, so it is made for a bucket and not for each track.

    ``tracks`` maps a track to what is kept of it; ``due`` is when the first of them is due, for which the bucket has its one timer.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", "tracks binary, due bigint")

    def _load(self) -> tuple[dict, int | None]:
        found = self.state.get()
        return (pickle.loads(bytes(found[0])), found[1]) if found else ({}, None)

    def _keep(self, tracks: dict, due: int | None, then: int, timerValues: TimerValues) -> None:
        then = max(then, timerValues.getCurrentWatermarkInMs() + 1)
        if due != then:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(then)
        self.state.update((pickle.dumps(tracks), then))

    def close(self) -> None:
        pass


def by_track(rows: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple[Any, list[np.ndarray]]]:
    """Each track with its columns, in the order of us and n."""
    pdf = pd.concat(list(rows))
    codes, names = pd.factorize(pdf["track"])
    order = np.lexsort((pdf["n"], pdf["us"], codes))
    ends = np.flatnonzero(np.diff(codes[order], append=len(names))) + 1
    parts = [np.split(pdf[c].to_numpy()[order], ends[:-1]) for c in columns]
    return zip(names.tolist(), map(list, zip(*parts)))


class InOrder(Bucketed):
    """Folds the samples (track, ts, us, n, x) of a track in the order of ts and n, whatever the micro-batches that they come in.

    Samples are held until the watermark has passed them, then given to ``fold`` with the state it left (None at first). When nothing is held and
    the watermark is ``idle_ms`` past the last sample, ``fold`` is told that the track has ended, and its state goes; a track that comes back starts
    anew. Samples behind the watermark are left out. What is held is at most the samples of the watermark's delay.
    """

    #: Names and types of the columns that ``fold`` gives besides track.
    out_type = ""

    def __init__(self, kind: str, idle_ms: int = 3_600_000) -> None:
        self.kind, self.idle_ms = kind, idle_ms

    def fold(self, state: tuple | None, rows: np.ndarray, ended: bool) -> tuple[tuple | None, dict[str, list]]:
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):
            return iter(())
        tracks, due = self._load()
        for track, (us, n, x) in by_track(rows, "us", "n", "x"):
            held, last, own = tracks.get(track, (b"", 0, None))
            every = np.empty(len(us), WAITING)
            every["ts"], every["n"], every["x"] = us, n, x
            if held:
                every = np.concatenate([np.frombuffer(held, WAITING), every])
                every = every[np.lexsort((every["n"], every["ts"]))]
            tracks[track] = (every.tobytes(), max(last, int(every["ts"][-1]) // 1000), own)
        self._wait(tracks, due, timerValues)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        tracks, _ = self._load()
        passed, names, made = timerValues.getCurrentWatermarkInMs(), [], []
        for track, (held, last, own) in list(tracks.items()):
            every = np.frombuffer(held, WAITING)
            ready = int(np.searchsorted(every["ts"], passed * 1000))
            ended = ready == len(every) and passed >= last + self.idle_ms
            if not ready and not ended:
                continue
            own, out = self.fold(own, every[:ready], ended)
            if ended:
                del tracks[track]
            else:
                tracks[track] = (every[ready:].tobytes(), last, own)
            names += [track] * len(next(iter(out.values())))
            made.append(out)
        if tracks:
            self._wait(tracks, None, timerValues)
        else:
            self.state.clear()
        if names:
            yield pd.DataFrame({"track": names} | {c: np.concatenate([m[c] for m in made if len(m[c])]) for c in made[0]})

    def _wait(self, tracks: dict, due: int | None, timerValues: TimerValues) -> None:
        """Keeps what waits, with a timer for when the first sample of it is passed, or a track without one counts as ended."""
        first = lambda held, last: int(np.frombuffer(held, WAITING, 1)["ts"][0]) // 1000 + 1 if held else last + self.idle_ms
        self._keep(tracks, due, min(first(held, last) for held, last, _ in tracks.values()), timerValues)


class LowPass(InOrder):
    """One-pole low-pass; its last output is the state."""

    out_type = "n bigint, y double"

    def __init__(self, kind: str, cut: float, rate: float, **more: Any) -> None:
        super().__init__(kind, **more)
        self.a = math.exp(-2 * math.pi * cut / rate)

    def fold(self, state, rows, ended):
        last, x = state[0] if state else 0.0, rows["x"].copy()
        y = iir(x, (1 - self.a,), (1.0, -self.a)) + last * self.a ** np.arange(1, len(x) + 1)
        return (float(y[-1]) if len(y) else last,), {"n": rows["n"], "y": y}


class LoudRuns(InOrder):
    """Runs of samples of at least a level that follow each other; a run is given when a quieter sample or the track's end closes it."""

    out_type = "us bigint, samples bigint, peak double"

    def __init__(self, kind: str, least: float, **more: Any) -> None:
        super().__init__(kind, **more)
        self.least = least

    def fold(self, state, rows, ended):
        start, samples, peak = state or (0, 0, 0.0)
        done = []
        for us, x in zip(rows["ts"].tolist(), np.abs(rows["x"]).tolist()):
            if x >= self.least:
                start, samples, peak = (start, samples + 1, max(peak, x)) if samples else (us, 1, x)
            elif samples:
                done.append((start, samples, peak))
                samples = 0
        if ended and samples:
            done.append((start, samples, peak))
        return (start, samples, peak), {c: [d[k] for d in done] for k, c in enumerate(("us", "samples", "peak"))}


class Onsets(InOrder):
    """Samples of at least a level, each at least ``gap_us`` after the last one that was accepted; its time is the state."""

    out_type = "n bigint, us bigint"

    def __init__(self, kind: str, least: float, gap_us: int, **more: Any) -> None:
        super().__init__(kind, **more)
        self.least, self.gap_us = least, gap_us

    def fold(self, state, rows, ended):
        last, taken = state[0] if state else None, []
        for us, n, x in rows.tolist():
            if abs(x) >= self.least and (last is None or us - last >= self.gap_us):
                last = us
                taken.append((n, us))
        return None if last is None else (last,), {"n": [t[0] for t in taken], "us": [t[1] for t in taken]}


class Ends(Bucketed):
    """A track's record once, as soon as it is whole (it has as many samples as its rows' ``expected`` says) or ``patience_ms`` after its
    last sample by the watermark. What is kept of a track is a state that merges in any order: sums, extremes and places. Samples after the record
    change nothing; the mark that says so goes after the same patience."""

    out_type = "samples bigint, whole boolean, dc double, power double, peak double, first_us bigint, last_us bigint"

    def __init__(self, kind: str, patience_ms: int = 3_600_000) -> None:
        self.kind, self.patience_ms = kind, patience_ms

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if pd.isna(key[0]):
            return
        tracks, due = self._load()
        whole = []
        for track, (us, x, sizes) in by_track(rows, "us", "x", "expected"):
            n, expected, total, squares, peak, first, last, _, done = tracks.get(track, (0, None, 0.0, 0.0, 0.0, None, 0, None, False))
            n, total, squares, peak = n + len(x), total + float(x.sum()), squares + float(x @ x), max(peak, float(np.abs(x).max()))
            first, last, expected = min(int(us[0]), first if first is not None else int(us[0])), max(last, int(us[-1])), int(sizes.max())
            then = max(last // 1000 + self.patience_ms, timerValues.getCurrentWatermarkInMs() + 1)
            now = not done and n >= expected
            tracks[track] = (n, expected, total, squares, peak, first, last, then, done or now)
            if now:
                whole.append(track)
        self._keep(tracks, due, min(t[7] for t in tracks.values()), timerValues)
        if whole:
            yield self._records(tracks, whole)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        tracks, _ = self._load()
        passed = timerValues.getCurrentWatermarkInMs()
        over = [track for track, t in tracks.items() if t[7] <= passed]
        late = [track for track in over if not tracks[track][8]]
        made = self._records(tracks, late) if late else None
        for track in over:
            del tracks[track]
        if tracks:
            self._keep(tracks, None, min(t[7] for t in tracks.values()), timerValues)
        else:
            self.state.clear()
        if made is not None:
            yield made

    def _records(self, tracks: dict, some: list) -> pd.DataFrame:
        made = [(track, n, n >= expected, total / n, squares / n, peak, first, last) for track in some for n, expected, total, squares, peak, first, last, _, _ in [tracks[track]]]
        return pd.DataFrame(made, columns=["track", "samples", "whole", "dc", "power", "peak", "first_us", "last_us"])


#: Keys of the state, among which tracks are dealt.
BUCKETS = 1024


def folded(stream: DataFrame, late: str, processor: InOrder | Ends, buckets: int = BUCKETS) -> DataFrame:
    """What the processor gives for each track of (track, ts, n, x, ...). The state lies in RocksDB, which ``spark.sql.streaming.stateStore.providerClass``
    must name; a key of it holds the tracks of one of ``buckets``. Rows without a track only move the watermark; a filter would be pushed below it."""
    timed = stream.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    made = timed.withColumn("bucket", F.when(F.col("track").isNotNull(), F.pmod(F.xxhash64("track"), F.lit(buckets)))).groupBy("bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"track {processor.kind}, {processor.out_type}", outputMode="Append", timeMode="EventTime")
    times = {c: F.timestamp_micros(c) for c in made.columns if c == "us" or c.endswith("_us")}
    return made.select(*[times[c].alias("ts" if c == "us" else c.removesuffix("_us")) if c in times else F.col(c) for c in made.columns])
