"""Loudness of a stream from histograms that merge: gated loudness and loudness range of what has passed, with bounds.

A level is counted in its bin of WIDTH LU, beside the sum of what it stands for (the power, or the level itself). Histograms add up in any order. A
gate cuts through one bin, so what it leaves is known up to the members of that bin: taking all and none of them gives bounds that hold the exact value.
"""

from __future__ import annotations

from typing import Any

import numpy as np

from ondine.operators.loudness import ABSOLUTE_GATE
from ondine.streaming.live import InOrder

#: LU of a bin.
WIDTH = 0.01
#: Levels that differ by less may change sides of a gate by rounding.
SLACK = 1e-9

BIN = np.dtype([("bin", "i8"), ("n", "i8"), ("sum", "f8")])


def level_of(power: np.ndarray | float) -> np.ndarray:
    return -0.691 + 10 * np.log10(power)


def binned(levels: np.ndarray, values: np.ndarray) -> np.ndarray:
    each = np.zeros(len(levels), BIN)
    each["bin"], each["n"], each["sum"] = np.floor(levels / WIDTH), 1, values
    return merged(each)


def merged(*parts: np.ndarray) -> np.ndarray:
    """One histogram of several, by rising bins."""
    every = np.concatenate(parts)
    bins, place = np.unique(every["bin"], return_inverse=True)
    out = np.zeros(len(bins), BIN)
    out["bin"] = bins
    np.add.at(out["n"], place, every["n"])
    np.add.at(out["sum"], place, every["sum"])
    return out


def _cut(level: float) -> tuple[int, int]:
    """First and last bin that a gate at this level may cut through."""
    return int(np.floor((level - SLACK) / WIDTH)), int(np.floor((level + SLACK) / WIDTH))


def gated_bounds(blocks: np.ndarray) -> tuple[float, float]:
    """Least and largest loudness of the blocks above a tenth of their mean power, of a histogram of powers above the absolute gate.

    Members of the bin that the gate cuts through are the quietest of those left, so each one lowers the mean.
    """
    if not len(blocks):
        return -np.inf, -np.inf
    first, last = _cut(level_of(blocks["sum"].sum() / blocks["n"].sum() * 0.1))
    mean = lambda h: float(level_of(h["sum"].sum() / h["n"].sum()))
    return mean(blocks[blocks["bin"] >= first]), mean(blocks[blocks["bin"] > last])


def range_bounds(windows: np.ndarray) -> tuple[float, float]:
    """Least and largest range from the 10th to the 95th percentile of the windows within 20 LU below their mean; 0 for fewer than two."""
    total = int(windows["n"].sum())
    if total < 2:
        return 0.0, 0.0
    first, last = _cut(windows["sum"].sum() / total - 20)
    run = windows["n"].cumsum()

    def at(share: float, dropped: int) -> int:
        """Bin of the percentile if so many windows lie below the gate; it doesn't fall as that number grows."""
        rank = min(total - 1, dropped + int(np.floor((total - dropped) * share)))
        return int(windows["bin"][np.searchsorted(run, rank, "right")])

    few, many = int(windows["n"][windows["bin"] < first].sum()), int(windows["n"][windows["bin"] <= last].sum())
    least = (at(0.95, few) - at(0.10, many) - 1) * WIDTH
    return max(0.0, least), (at(0.95, many) + 1 - at(0.10, few)) * WIDTH


class Loudness(InOrder):
    """Bounds of a track's gated loudness and loudness range, given when it ends. ``rate``: samples of a second, a multiple of ten.

    State: the number of samples, the sum of the open hop of a tenth of a second, the sums of the 29 hops before it, and two histograms of at most some
    ten thousand bins each, however long the track.
    """

    out_type = "samples bigint, gated_low double, gated_high double, lra_low double, lra_high double"

    def __init__(self, kind: str, rate: int, **more: Any) -> None:
        super().__init__(kind, **more)
        if rate % 10:
            raise ValueError(f"a rate of {rate} has no whole hops of a tenth of a second")
        self.hop = rate // 10

    def fold(self, state, rows, ended):
        samples, part, hops, blocks, windows = state or (0, 0.0, b"", b"", b"")
        old, blocks, windows = np.frombuffer(bytes(hops), "f8"), np.frombuffer(bytes(blocks), BIN), np.frombuffer(bytes(windows), BIN)
        at = (samples + np.arange(len(rows))) // self.hop - samples // self.hop
        sums = np.bincount(at, rows["x"] ** 2, minlength=1)
        sums[0] += part
        done = (samples + len(rows)) // self.hop - samples // self.hop
        part = float(sums[done]) if done < len(sums) else 0.0
        every = np.concatenate([old, sums[:done]])
        start = samples // self.hop - len(old)  # number of the first hop that is held

        def passed(width: int, step: int) -> np.ndarray:
            """Powers of the windows of so many hops that end in a new hop."""
            if len(every) < width:
                return np.zeros(0)
            firsts = np.arange(len(every) - width + 1)
            own = (firsts + width > len(old)) & ((start + firsts) % step == 0)
            return np.lib.stride_tricks.sliding_window_view(every, width)[own].sum(1) / (width * self.hop)

        gate, short = passed(4, 3), passed(30, 1)
        gate, short = gate[gate >= ABSOLUTE_GATE], level_of(short[short > 0])
        short = short[short > -70]
        blocks, windows = merged(blocks, binned(level_of(gate), gate)), merged(windows, binned(short, short))
        samples += len(rows)
        left = (samples, part, every[-29:].tobytes(), blocks.tobytes(), windows.tobytes())
        names = ("samples", "gated_low", "gated_high", "lra_low", "lra_high")
        values = (samples, *gated_bounds(blocks), *range_bounds(windows)) if ended else None
        return left, {c: [values[k]] if values else [] for k, c in enumerate(names)}
