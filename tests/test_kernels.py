"""Numerical kernels against plain definitions."""

from __future__ import annotations

import numpy as np
import pytest

from lapframe.functions.kernels import (
    Line, butterworth_lowpass, s_curve, segment_labels, window_starts, zero_phase,
)
from tests.plain_corners import find_peaks, local_maxima, prominence
from lapframe.operators.stiffness import SECTION_ORDER, SPAN_RAD, _largest, fit_magic_formula, magic_formula, magic_formula_slope, section_slopes, stiffness


@pytest.fixture
def rng():
    return np.random.default_rng(4)


def test_lowpass_response():
    b, a = butterworth_lowpass(4, 0.1)
    gain = lambda f: abs(np.polyval(b[::-1], np.exp(-1j * np.pi * f)) / np.polyval(a[::-1], np.exp(-1j * np.pi * f)))
    assert gain(1e-9) == pytest.approx(1)
    assert gain(0.1) == pytest.approx(np.sqrt(0.5), rel=1e-9)
    assert gain(0.5) < 1e-3
    assert np.all(np.abs(np.roots(a)) < 1)


def test_zero_phase_keeps_lines_and_slow_waves():
    b, a = butterworth_lowpass(4, 0.1)
    line = 3 + 0.5 * np.arange(200.0)
    assert np.allclose(zero_phase(b, a, line)[60:-60], line[60:-60], atol=1e-3)
    assert np.allclose(zero_phase(b, a, np.full(40, 7.0)), 7.0)
    t = np.arange(1000)
    slow, fast = np.sin(t * 2 * np.pi / 400), np.sin(t * 2 * np.pi / 4)
    assert np.allclose(zero_phase(b, a, slow + fast)[100:-100], slow[100:-100], atol=0.01)
    with pytest.raises(ValueError):
        zero_phase(b, a, np.ones(15))


def test_local_maxima_and_plateaus():
    assert local_maxima(np.array([0, 1, 0, 2, 2, 2, 0, 3.0])).tolist() == [1, 4]
    assert local_maxima(np.array([1.0, 1, 1])).tolist() == []
    assert local_maxima(np.array([])).tolist() == []


def test_find_peaks_filters():
    x = np.zeros(1000)
    bump = np.hanning(201)
    for at, h in ((200, 1.0), (260, 0.6), (600, 0.8), (900, 0.001)):
        x[at - 100 : at + 100 + 1][: len(x) - at + 100] += h * bump[: len(x) - at + 100]
    assert find_peaks(x, 0.002, 100, 0.001, 50).tolist() == [int(np.argmax(x[:400])), 600]
    assert find_peaks(x, 0.9, 1, 0.001, 0).tolist() == [int(np.argmax(x[:400]))]
    assert prominence(np.array([0, 2, 1, 3, 0.0]), 1)[0] == 1


def test_window_starts(rng):
    x = np.cumsum(rng.normal(size=300)) * 0.01
    got = window_starts(x, 0.05)
    for i in range(len(x)):
        want = next(s for s in range(i + 1) if x[s : i + 1].max() - x[s : i + 1].min() < 0.05)
        assert got[i] == want


def test_segment_labels():
    assert segment_labels(np.array([0, 1, 2, 1, 0, 0, 3.0])).tolist() == [0, 0, 0, 1, 1, 2, 3]
    assert segment_labels(np.array([1.0])).tolist() == [0]


def test_s_curve():
    w = s_curve(np.array([0, 0.25, 0.5, 0.75, 1, np.nan]), 0, 1, 2)
    assert w.tolist() == pytest.approx([0, 0.125, 0.5, 0.875, 1, 0])


def test_line_fits(rng):
    x, y = rng.normal(size=50), rng.normal(size=50)
    start, end = np.array([0, 10, 20, 3]), np.array([49, 30, 21, 5])
    slope, r2 = Line(x, y).fit(start, end)
    for k in (0, 1, 3):
        i, j = start[k], end[k] + 1
        m, c = np.polyfit(x[i:j], y[i:j], 1)
        rest = ((y[i:j] - m * x[i:j] - c) ** 2).sum() / ((y[i:j] - y[i:j].mean()) ** 2).sum()
        assert slope[k] == pytest.approx(m) and r2[k] == pytest.approx(1 - rest)
    assert np.isnan(slope[2]) and np.isnan(r2[2])


def test_section_slopes(rng):
    x = np.cumsum(rng.normal(size=250)) * 0.004
    y = 1000 * x + rng.normal(size=250)
    starts, label, line = window_starts(x, SPAN_RAD), segment_labels(x), Line(x, y)
    got = section_slopes(x, line, starts)
    for i in range(len(x)):
        own = np.arange(starts[i], i + 1)
        parts = [own[label[own] == k] for k in np.unique(label[own])]
        slopes, weights = [], []
        for p in parts:
            if len(p) >= 3:
                slopes.append(np.polyfit(x[p], y[p], 1)[0])
                weights.append(s_curve(np.array([np.ptp(x[p])]), 0, SPAN_RAD, SECTION_ORDER)[0])
        if sum(weights) > 1e-12:
            assert got[i] == pytest.approx(np.dot(slopes, weights) / sum(weights), rel=1e-6)


def test_largest(rng):
    x = rng.normal(size=200)
    starts = np.maximum(0, np.arange(200) - rng.integers(0, 60, 200))
    assert _largest(x, starts).tolist() == [x[s : i + 1].max() for i, s in enumerate(starts)]


def test_stiffness_of_a_linear_tyre():
    t = np.arange(2000) / 100
    slip = 0.01 * np.sin(t) + 0.008 * np.sin(2.3 * t)
    value, ratio = stiffness(slip, 80_000 * slip, 100.0)
    assert np.nanmax(np.abs(value[50:] - 80_000)) < 1
    assert np.nanmax(np.abs(ratio[50:] - 1)) < 1e-6


def test_magic_formula():
    slip = np.linspace(-0.15, 0.15, 301)
    force = magic_formula(slip, 10, 1.6, 7000, 0.5)
    found = fit_magic_formula(slip, force)
    assert np.abs(magic_formula(slip, *found) - force).max() < 30
    h = 1e-6
    assert np.allclose(magic_formula_slope(slip, 10, 1.6, 7000, 0.5), (magic_formula(slip + h, 10, 1.6, 7000, 0.5) - magic_formula(slip - h, 10, 1.6, 7000, 0.5)) / (2 * h), rtol=1e-4)


def test_window_starts_by_definition(rng):
    for n in (1, 2, 3, 8, 130):
        x = np.cumsum(rng.normal(size=n)) * 0.01
        want = [next(k for k in range(i + 1) if k == i or np.ptp(x[k : i + 1]) < 0.02) for i in range(n)]
        assert window_starts(x, 0.02).tolist() == want
