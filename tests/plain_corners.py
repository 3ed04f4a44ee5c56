"""Peaks and corner labels of one lap in NumPy: the plain version that the queries are held to."""

from __future__ import annotations

import numpy as np
import pandas as pd

from lapframe.operators.corners import (
    APEX, APEX_LATERAL, DECEL_GAP_M, DECEL_LEVEL, DECEL_QUANTILE, DECEL_ROWS, LOW_GAP_M, LOW_LATERAL, NEAR_ROWS, NONE, PHASE_LEVELS, PHASES, SIGN_GAP_M, STRAIGHT,
)


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Places strictly above both sides; of a plateau its middle, rounded down. The ends are none."""
    if len(x) < 3:
        return np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    ends = np.r_[starts[1:], len(x)] - 1
    level = x[starts]
    above = np.zeros(len(starts), bool)
    above[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    return (starts[above] + ends[above]) // 2


def _spaced(places: np.ndarray, height: np.ndarray, distance: float) -> np.ndarray:
    """Keep flags: the highest first (the later one of equals), each removes what lies closer than ``distance``."""
    keep = np.ones(len(places), bool)
    for k in np.argsort(height, kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(places - places[k]) < distance
            near[k] = False
            keep &= ~near
    return keep


def prominence(x: np.ndarray, peak: int) -> tuple[float, int, int]:
    """Height over the higher of the two lowest points between the peak and anything above it, and those points."""
    above_left = np.flatnonzero(x[:peak] > x[peak])
    i = int(above_left[-1]) + 1 if len(above_left) else 0
    above_right = np.flatnonzero(x[peak + 1 :] > x[peak])
    j = peak + int(above_right[0]) if len(above_right) else len(x) - 1
    left = peak - int(np.argmin(x[i : peak + 1][::-1]))
    right = peak + int(np.argmin(x[peak : j + 1]))
    return float(x[peak] - max(x[left], x[right])), left, right


def width_at_half(x: np.ndarray, peak: int, height: float, left: int, right: int) -> float:
    """Distance between the crossings of half the prominence, linear between samples."""
    level = x[peak] - height / 2.0
    i = peak
    while i > left and x[i] > level:
        i -= 1
    a = float(i) + ((level - x[i]) / (x[i + 1] - x[i]) if x[i] < level else 0.0)
    j = peak
    while j < right and x[j] > level:
        j += 1
    b = float(j) - ((level - x[j]) / (x[j - 1] - x[j]) if x[j] < level else 0.0)
    return b - a


def find_peaks(x: np.ndarray, height: float, distance: float, least_prominence: float, least_width: float) -> np.ndarray:
    """Local maxima by height, then spacing, then prominence, then width."""
    places = local_maxima(x)
    places = places[x[places] >= height]
    places = places[_spaced(places, x[places], distance)]
    out = []
    for p in places.tolist():
        own, left, right = prominence(x, p)
        if own >= least_prominence and width_at_half(x, p, own, left, right) >= least_width:
            out.append(p)
    return np.array(out, np.int64)


def _stretches(at: np.ndarray, s: np.ndarray, gap: float) -> list[np.ndarray]:
    return np.split(at, np.flatnonzero(np.diff(s[at]) >= gap) + 1) if len(at) else []


def _forward_quantile(x: np.ndarray) -> np.ndarray:
    return pd.Series(x[::-1]).rolling(DECEL_ROWS, min_periods=1).quantile(DECEL_QUANTILE).to_numpy()[::-1]


def _points(s: np.ndarray, curvature: np.ndarray, lateral: np.ndarray, ratio: np.ndarray) -> list[tuple[int, str]]:
    """All characteristic points of a lap in order."""
    apices = find_peaks(np.abs(curvature), **APEX)
    apices = apices[np.abs(lateral[apices]) > APEX_LATERAL]
    if not len(apices):
        return []
    crossing = lambda x: np.diff(np.sign(x)) != 0
    changes = [int(np.median(g)) for g in _stretches(np.flatnonzero(crossing(lateral)), s, SIGN_GAP_M)]
    straight = np.abs(curvature[1:]) < STRAIGHT
    low = np.sort(np.concatenate([np.flatnonzero(crossing(lateral - level) & straight) for level in (LOW_LATERAL, -LOW_LATERAL)]))
    lows = [int(np.median(g)) for g in _stretches(low, s, LOW_GAP_M)]
    turning = (np.gradient(np.sign(ratio - DECEL_LEVEL)) != 0) & (_forward_quantile(np.gradient(ratio)) < 0)
    brakes = [int(g[-1]) for g in _stretches(np.flatnonzero(turning), s, DECEL_GAP_M)]
    near = np.array(changes)
    lows = [p for p in lows if not len(near) or np.abs(near - p).min() > NEAR_ROWS]
    return sorted([*((int(p), "apex") for p in apices), *((p, "deceleration") for p in brakes), *((p, "lat_accel_change") for p in changes), *((p, "low_lat_accel") for p in lows)])


def _bounds(points: list[tuple[int, str]], apex: int) -> tuple[int, int]:
    """(start, end) of the corner around the ``apex``-th point; both wrap around the lap's ends."""
    n, far = len(points), None
    k = (apex - 1) % n
    for _ in range(n):
        kind = points[k][1]
        if kind == "deceleration":
            start = points[k][0]
            break
        if kind == "apex":
            start = points[far if far is not None else apex][0]
            break
        far = k if far is None else far
        k = (k - 1) % n
    after = (apex + 1) % n
    return start, points[apex if points[after][1] == "apex" else after][0]


def _phases(ratio: np.ndarray) -> list[str]:
    """Each phase begins at the last row, from the phase before on, that lies under its level."""
    at, counts = 0, np.zeros(len(ratio), int)
    for level in PHASE_LEVELS:
        under = np.flatnonzero(ratio[at:] < level)
        at += int(under[-1]) if len(under) else 0
        counts[at] += 1
    return [PHASES[k] for k in np.cumsum(counts)]


def label_lap(s: np.ndarray, curvature: np.ndarray, lateral: np.ndarray, speed: np.ndarray, ratio: np.ndarray) -> tuple[list[str], list[str], list[str]]:
    """corner_name, corner_speed and corner_phase of each row; ``-`` outside corners."""
    n = len(s)
    name, pace, phase = [NONE] * n, [NONE] * n, [NONE] * n
    points = _points(s, curvature, lateral, ratio) if n > 2 else []
    apices = [k for k, (_, kind) in enumerate(points) if kind == "apex"]
    for number, k in enumerate(apices, 1):
        start, end = _bounds(points, k)
        v = speed[points[k][0]]
        kind = "Low Speed" if v < 25 else "Medium Speed" if v < 40 else "High Speed"
        length = (end - start) % n or n  # a corner that ends where it starts is the whole lap
        for at in (start + np.arange(length)) % n:
            name[at], pace[at] = f"T{number}", kind
    names = np.array(name)
    for corner in set(name) - {NONE}:
        rows = np.flatnonzero(names == corner)
        for at, what in zip(rows.tolist(), _phases(ratio[rows]), strict=True):
            phase[at] = what
    return name, pace, phase
