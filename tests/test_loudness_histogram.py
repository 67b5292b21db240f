"""Bounds of a stream's loudness hold the exact values, whatever the batches."""

from __future__ import annotations

import numpy as np
import pytest

from ondine.operators.loudness import ABSOLUTE_GATE
from ondine.streaming import histogram as H
from ondine.streaming.live import WAITING


def signal(seed: int) -> np.ndarray:
    draw = np.random.default_rng(seed)
    parts = [draw.normal(size=int(draw.integers(1, 400))) * 10 ** draw.uniform(-4.5, 0) for _ in range(int(draw.integers(1, 12)))]
    return np.concatenate(parts)


def exact(x: np.ndarray, rate: int) -> tuple[float, float]:
    p = np.array([np.mean(x[i : i + int(rate * 0.4)] ** 2) for i in range(0, len(x) - int(rate * 0.4) + 1, int(rate * 0.4 * 0.75))])
    p = p[p >= ABSOLUTE_GATE] if len(p) else p
    gated = H.level_of(p[p >= p.mean() * 0.1].mean()) if len(p) else -np.inf
    v = np.array([np.mean(x[i : i + rate * 3] ** 2) for i in range(0, len(x) - rate * 3 + 1, rate // 10)])
    v = H.level_of(v[v > 0])
    v = v[v > -70]
    if len(v) < 2:
        return gated, 0.0
    s = np.sort(v[v >= v.mean() - 20])
    return gated, max(0.0, s[int(len(s) * 0.95)] - s[int(len(s) * 0.10)])


def folded(x: np.ndarray, rate: int, cuts: list[int]) -> dict:
    own = H.Loudness("bigint", rate)
    rows = np.rec.fromarrays([np.arange(len(x)), np.arange(len(x)), x], dtype=WAITING)
    state = None
    for a, b in zip([0, *cuts], [*cuts, len(x)]):
        state, out = own.fold(state, rows[a:b], b == len(x) and a == ([0, *cuts][-1]))
    return {c: v[0] for c, v in out.items()}


@pytest.mark.parametrize("seed", range(40))
def test_bounds_hold_the_exact_values(seed):
    x, rate = signal(seed), 10 if seed % 2 else 20
    draw = np.random.default_rng(seed)
    cuts = sorted(draw.integers(0, len(x) + 1, int(draw.integers(0, 9))).tolist())
    got, whole = folded(x, rate, cuts), folded(x, rate, [])
    assert got["samples"] == len(x) and all(got[c] == pytest.approx(whole[c], abs=1e-9) for c in got)
    gated, lra = exact(x, rate)
    assert got["gated_low"] - 1e-9 <= gated <= got["gated_high"] + 1e-9
    assert got["lra_low"] - 1e-9 <= lra <= got["lra_high"] + 1e-9
    assert got["lra_low"] <= got["lra_high"]


def test_bounds_are_narrow_where_the_gate_cuts_through_no_one():
    x = np.tile(np.repeat([0.5, 0.25], 300), 4)
    got = folded(x, 10, [7, 450])
    assert got["gated_high"] - got["gated_low"] < 1e-9 and got["lra_high"] - got["lra_low"] <= 2 * H.WIDTH + 1e-9


def test_short_and_silent_tracks():
    assert folded(np.zeros(0), 10, []) == {"samples": 0, "gated_low": -np.inf, "gated_high": -np.inf, "lra_low": 0.0, "lra_high": 0.0}
    assert folded(np.zeros(500), 10, [3])["gated_high"] == -np.inf
    with pytest.raises(ValueError):
        H.Loudness("bigint", 25)


def test_histograms_add_up_in_any_order():
    draw = np.random.default_rng(1)
    parts = [H.binned(v, v) for v in np.split(draw.normal(-20, 3, 900), 9)]
    a, b = H.merged(*parts), H.merged(H.merged(*parts[4:]), H.merged(*parts[:4]))
    assert (a["bin"] == b["bin"]).all() and (a["n"] == b["n"]).all() and np.allclose(a["sum"], b["sum"]) and a["n"].sum() == 900
