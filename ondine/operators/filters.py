"""Linear recurrences over tracks: one-pole filters, biquads, K-weighting and band-passes, all as chains of sections (b, a).

Spark has no recurrence over ordered rows, but a section hands only its last few inputs and outputs on. So a track is cut into
blocks of SIZE samples, each a group of its own: a first pass gives what every block alone leaves behind, a short table carries these states
from block to block of a track, and a second pass runs every block from its true state. No task holds more samples than a block.
Within a block, what each stretch's own inputs give is one matrix product for all stretches, and only the few values that
one hands to the next are stepped through.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The two stages of K-weighting as (b, a). The first is the 48 kHz set at every rate.
SHELF = ((1.53512485958697, -2.69169618940638, 1.19839281085285), (1.0, -1.69065929318241, 0.73248077421585))
HIGH_PASS_48K = ((1.0, -2.0, 1.0), (1.0, -1.99004745483398, 0.99007225036621))
HIGH_PASS_44K = ((1.0, -2.0, 1.0), (1.0, -1.98912696790837, 0.98913691860121))
#: Bands of the per-band loudness, in Hz.
BANDS = (("sub", 20, 80), ("bass", 80, 250), ("mid", 250, 2000), ("presence", 2000, 6000), ("brilliance", 6000, 20000))

#: Samples of a stretch of one matrix product, and of a block of a track.
BLOCK, SIZE = 256, 1 << 16

#: Coefficients of the inputs and of the outputs; the first of the latter is 1.
Section = tuple[tuple[float, ...], tuple[float, ...]]


@functools.lru_cache(maxsize=64)
def _matrices(b: tuple[float, ...], a: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: outputs from its inputs, from the inputs before it, and from the outputs before it."""
    p = max(len(a), len(b)) - 1

    def run(x: np.ndarray, xs: list[float], ys: list[float]) -> np.ndarray:
        out = []
        for v in x:
            xs = [v, *xs]
            y = sum(c * u for c, u in zip(b, xs)) - sum(c * u for c, u in zip(a[1:], ys))
            ys = [y, *ys]
            out.append(y)
        return np.array(out)

    impulse = run(np.eye(BLOCK)[0], [], [])
    own = np.array([[impulse[i - j] if i >= j else 0.0 for j in range(BLOCK)] for i in range(BLOCK)])
    unit = [[float(i == j) for j in range(p)] for i in range(p)]
    none = np.zeros(BLOCK)
    return own, np.stack([run(none, u, [0.0] * p) for u in unit], 1), np.stack([run(none, [0.0] * p, u) for u in unit], 1)


def iir(x: np.ndarray, b: tuple[float, ...], a: tuple[float, ...], before_x: np.ndarray | None = None, before_y: np.ndarray | None = None) -> np.ndarray:
    """y[n] = sum b[k] x[n-k] - sum a[k] y[n-k]; a[0] is 1. ``before_x`` and ``before_y`` are the last inputs and outputs, latest first (rest)."""
    own, from_x, from_y = _matrices(tuple(b), tuple(a))
    p, n = from_x.shape[1], len(x)
    blocks = np.zeros((-(-max(n, 1) // BLOCK), BLOCK))
    blocks.ravel()[:n] = x
    before = np.zeros((len(blocks), p))
    before[1:] = blocks[:-1, : -p - 1 : -1]
    before[0] = 0 if before_x is None else before_x
    z = blocks @ own.T + before @ from_x.T
    state, states, tail = np.zeros(p) if before_y is None else before_y, np.empty((len(blocks), p)), from_y[: -p - 1 : -1]
    for k, end in enumerate(z[:, : -p - 1 : -1]):
        states[k] = state
        state = end + tail @ state
    return (z + states @ from_y.T).ravel()[:n]


def width(sections: list[Section]) -> int:
    """Numbers that a chain hands on."""
    return sum(2 * (max(len(a), len(b)) - 1) for b, a in sections)


def cascade(x: np.ndarray, sections: list[Section], state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The outputs of a chain of sections from a state (rest), and the state that it ends in."""
    state, at, after = np.zeros(width(sections)) if state is None else state, 0, []
    for b, a in sections:
        p = max(len(a), len(b)) - 1
        xs, ys = state[at : at + p], state[at + p : at + 2 * p]
        y = iir(x, b, a, xs, ys)
        after += [np.concatenate([xs[::-1], x[-p:]])[: -p - 1 : -1], np.concatenate([ys[::-1], y[-p:]])[: -p - 1 : -1]]
        x, at = y, at + 2 * p
    return x, np.concatenate(after)


def low_pass(cut: float, rate: float) -> list[Section]:
    """One pole: y = (1 - a) x + a y', a = exp(-2 pi cut / rate)."""
    a = math.exp(-2 * math.pi * cut / rate)
    return [((1 - a,), (1.0, -a))]


def high_pass(cut: float, rate: float) -> list[Section]:
    """What the low-pass leaves of its input."""
    a = math.exp(-2 * math.pi * cut / rate)
    return [((a, -a), (1.0, -a))]


def band_pass(low: float, high: float, rate: float) -> list[Section]:
    """A high-pass, then a low-pass, of 6 dB an octave each; neighbouring bands leak into it."""
    return high_pass(low, rate) + low_pass(high, rate)


def k_weighting(rate: float) -> list[Section]:
    return [SHELF, HIGH_PASS_44K if rate == 44100 else HIGH_PASS_48K]


def carried(ends: DataFrame, kernels: dict[str, tuple[str, list[Section]]], size: int) -> DataFrame:
    """From (track, block, state) that each block alone leaves, the states in which the next blocks are entered: (track, block, state)."""
    widths = [width(k) for _, k in kernels.values()]

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        """A state passes through a block as through silence, and what the block alone leaves is added."""
        pdf = pdf.sort_values("block", ignore_index=True)
        state, states = np.zeros(sum(widths)), []
        for end in pdf["state"]:
            parts = np.split(state, np.cumsum(widths)[:-1])
            state = end + np.concatenate([_through(tuple(k), size) @ s for (_, k), s in zip(kernels.values(), parts)])
            states.append(state)
        return pd.DataFrame({"track": pdf["track"], "block": pdf["block"] + 1, "state": states})

    return ends.groupBy("track").applyInPandas(carry, f"track {ends.schema['track'].dataType.simpleString()}, block bigint, state array<double>")


def mapped(signals: DataFrame, kernels: dict[str, tuple[str, list[Section]]], size: int = SIZE) -> DataFrame:
    """Adds columns (name: (source column, sections)) to (track, n, ...); n counts a track's samples from 0 without a gap."""
    kind, widths = signals.schema["track"].dataType.simpleString(), [width(k) for _, k in kernels.values()]
    sources = list(dict.fromkeys(source for source, _ in kernels.values()))
    block = F.floor(F.col("n") / size).cast("bigint")
    rows = signals.withColumn("block", block)

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", ignore_index=True)
        ends = [cascade(pdf[source].to_numpy(np.float64), sections)[1] for source, sections in kernels.values()]
        return pd.DataFrame({"track": pdf["track"][:1], "block": pdf["block"][:1], "state": [np.concatenate(ends)]})

    def run(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", ignore_index=True)
        state = np.array(before["state"][0]) if len(before) else np.zeros(sum(widths))
        for (out, (source, sections)), own in zip(kernels.items(), np.split(state, np.cumsum(widths)[:-1])):
            pdf[out] = cascade(pdf[source].to_numpy(np.float64), sections, own)[0]
        return pdf.drop(columns="block")

    # the last block of a track hands nothing on, so tracks of one block leave the first pass at once
    last = signals.groupBy("track").agg(F.floor(F.max("n") / size).cast("bigint").alias("last"))
    early = rows.select("track", "n", "block", *sources).join(last, "track").where("block < last").drop("last")
    states = early.groupBy("track", "block").applyInPandas(alone, f"track {kind}, block bigint, state array<double>")
    states = carried(states, kernels, size)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in signals.schema.fields), *(f"`{o}` double" for o in kernels)])
    return rows.groupBy("track", "block").cogroup(states.groupBy("track", "block")).applyInPandas(run, schema)


@functools.lru_cache(maxsize=64)
def _through(sections: tuple[Section, ...], size: int) -> np.ndarray:
    """What a block of silence makes of a chain's state."""
    n = width(list(sections))
    return np.stack([cascade(np.zeros(size), list(sections), unit)[1] for unit in np.eye(n)], 1)
