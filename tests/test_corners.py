"""Corner labels on a track of two straights and two bends, and the point queries against the labels' own lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapframe.functions.series import with_position
from lapframe.operators.corners import corner_bounds, deceleration_points, label_corners, low_acceleration_points, peaks, sign_changes
from tests.plain_corners import _bounds, _points, find_peaks, label_lap, prominence, width_at_half


def lap(n: int = 2000, seed: int = 0):
    """Two bends (one each way) of raised-cosine curvature, with braking before each."""
    s = np.linspace(0, 1000, n, endpoint=False)
    curvature, ratio = np.zeros(n), np.full(n, 0.9)
    for at, sign in ((500, 1), (1400, -1)):
        curvature[at - 150 : at + 150] += sign * 0.02 * np.hanning(300)
        ratio[at - 300 : at + 150] = np.interp(np.arange(450), [0, 100, 200, 300, 450], [0.9, -0.99, -0.98, 0.0, 0.9])
    speed = 45 - 1200 * np.abs(curvature)
    noise = np.random.default_rng(seed).normal(scale=1e-6, size=n)
    return s, curvature + noise, speed**2 * curvature + noise, speed, ratio


def test_labels():
    s, curvature, lateral, speed, ratio = lap()
    name, pace, phase = label_lap(s, curvature, lateral, speed, ratio)
    assert set(name) == {"-", "T1", "T2"}
    first = [k for k, x in enumerate(name) if x == "T1"]
    assert first[0] < 500 < first[-1] and first == list(range(first[0], first[-1] + 1))
    assert {pace[k] for k in first} == {"Low Speed"}
    assert [phase[k] for k in first][0] == "Braking" and [phase[k] for k in first][-1] == "Exit"
    order = ["Braking", "Entry", "Mid", "Exit"]
    assert [phase[k] for k in first] == sorted((phase[k] for k in first), key=order.index)
    assert all((p == "-") == (x == "-") for p, x in zip(phase, name, strict=True))


def test_no_corner():
    n = 300
    name, pace, phase = label_lap(np.arange(n) * 1.0, np.zeros(n), np.zeros(n), np.full(n, 30.0), np.zeros(n))
    assert set(name) == set(pace) == set(phase) == {"-"}


def _frame(spark):
    parts = []
    for k in range(2):
        s, curvature, lateral, speed, ratio = lap(seed=k)
        parts.append(pd.DataFrame({"run_id": "a", "seq": np.arange(len(s)) + k * len(s), "n_lap": k + 1, "s_m": s, "curvature_smoothed": curvature, "ay_mps2_smoothed": lateral, "v_mps": speed, "r_cos_phi_smoothed": ratio}))
    return spark.createDataFrame(pd.concat(parts))


def test_on_spark(spark):
    df = _frame(spark)
    got = label_corners(df).toPandas().sort_values("seq")
    for k in (1, 2):
        own = got[got.n_lap == k]
        wanted = label_lap(*(own[c].to_numpy() for c in ("s_m", "curvature_smoothed", "ay_mps2_smoothed", "v_mps", "r_cos_phi_smoothed")))
        assert (own.corner_name.tolist(), own.corner_speed.tolist(), own.corner_phase.tolist()) == wanted
    with pytest.raises(ValueError, match="v_mps"):
        label_corners(df.drop("v_mps"))


def test_point_queries(spark):
    df = _frame(spark)
    changes = sign_changes(df, "ay_mps2_smoothed").toPandas()
    lows = low_acceleration_points(df).toPandas()
    brakes = deceleration_points(df).toPandas()
    for k in (1, 2):
        s, curvature, lateral, _, ratio = lap(seed=k - 1)
        points = _points(s, curvature, lateral, ratio)
        of = lambda kind: sorted(p for p, x in points if x == kind)  # noqa: B023, E731
        assert sorted(changes[changes.n_lap == k].pos) == of("lat_accel_change")
        assert sorted(brakes[brakes.n_lap == k].pos) == of("deceleration")
        near = np.array(of("lat_accel_change"))
        assert [p for p in sorted(lows[lows.n_lap == k].pos) if not len(near) or np.abs(near - p).min() > 30] == of("low_lat_accel")


def _wandering(seed: int, n: int):
    """A lap of random bends, with flat and equal stretches."""
    rng = np.random.default_rng(seed)
    knots = np.r_[rng.normal(0, 0.012, 14).round(3)]
    curvature = np.interp(np.arange(n), np.linspace(0, n - 1, 14), knots)
    curvature = np.convolve(np.pad(curvature, 15, mode="edge"), np.ones(31) / 31, mode="valid").round(5)
    speed = 45 - 900 * np.abs(curvature)
    ratio = np.interp(np.arange(n), np.linspace(0, n - 1, 20), rng.uniform(-1, 1, 20))
    return np.arange(n) * 2.0, curvature, speed**2 * curvature, speed, ratio


def _table(spark, laps):
    names = ("s_m", "curvature_smoothed", "ay_mps2_smoothed", "v_mps", "r_cos_phi_smoothed")
    parts = [pd.DataFrame({"run_id": f"r{k % 3}", "seq": np.arange(len(x[0])) + 10_000 * k, "n_lap": k} | dict(zip(names, x, strict=True))) for k, x in laps.items()]
    return spark.createDataFrame(pd.concat(parts))


def test_peaks_in_any_series(spark):
    laps = {k: _wandering(k, n) for k, n in enumerate([2, 3, 60, 300, 900, 900, 1500, 1500])}
    rng = np.random.default_rng(9)
    laps |= {20 + k: tuple([np.arange(200.0), rng.integers(0, 4, 200) / 100.0, np.zeros(200), np.zeros(200), np.zeros(200)]) for k in range(6)}
    placed = with_position(_table(spark, laps).withColumn("x", F.abs("curvature_smoothed")), ["run_id", "n_lap"])
    for options in ({"height": 0.002, "distance": 100, "least_prominence": 0.001, "least_width": 50}, {"height": 0.01, "distance": 3, "least_prominence": 0.01, "least_width": 1}):
        got = peaks(placed, "x", ["run_id", "n_lap"], **options).toPandas()
        for k, (_, curvature, *_) in laps.items():
            x, own = np.abs(curvature), got[got.n_lap == k].sort_values("pos")
            assert own.pos.tolist() == find_peaks(x, **options).tolist()
            for p, high, wide in zip(own.pos, own.prominence, own.width, strict=True):
                h, left, right = prominence(x, p)
                assert high == pytest.approx(h) and wide == pytest.approx(width_at_half(x, p, h, left, right))
    assert len(got) > 20


def test_bounds_around_the_lap(spark):
    rng = np.random.default_rng(8)
    kinds, rows, want = ["apex", "deceleration", "lat_accel_change", "low_lat_accel"], [], set()
    for lap_no in range(60):
        points = sorted({(int(rng.integers(0, 30)), str(rng.choice(kinds))) for _ in range(rng.integers(1, 9))} | {(int(rng.integers(0, 30)), "apex")})
        rows += [("a", lap_no, p, k) for p, k in points]
        apices = [k for k, (_, kind) in enumerate(points) if kind == "apex"]
        want |= {("a", lap_no, no, points[k][0], *_bounds(points, k)) for no, k in enumerate(apices, 1)}
    got = corner_bounds(spark.createDataFrame(rows, "run_id string, n_lap int, pos long, kind string"))
    assert {tuple(r) for r in got.collect()} == want


def test_labels_of_wandering_laps(spark):
    laps = {k: _wandering(100 + k, n) for k, n in enumerate([2, 3, 400, 900, 900, 1500, 1500, 2000])}
    got = label_corners(_table(spark, laps)).toPandas().sort_values("seq")
    seen = set()
    for k, x in laps.items():
        own = got[got.n_lap == k]
        assert (own.corner_name.tolist(), own.corner_speed.tolist(), own.corner_phase.tolist()) == label_lap(*x)
        seen |= set(own.corner_name)
    assert {"-", "T1", "T2", "T3"} <= seen


def test_labels_read_the_table_once(spark):
    """The labels come with the table's own columns, whatever their names; nothing is joined back to it."""
    df = _frame(spark).withColumns({"pos": F.col("seq") * 2, "corner": F.lit("own")})
    got = label_corners(df)
    assert got.columns == [*df.columns, "corner_name", "corner_speed", "corner_phase"]
    assert not any(x in got._jdf.queryExecution().optimizedPlan().toString() for x in ("LogicalRDD", "LocalRelation"))
    rows = got.collect()
    assert len(rows) == df.count() and all(r.pos == 2 * r.seq and r.corner == "own" for r in rows)


def test_quantiles_where_a_turn_reaches_alone(spark):
    """The quantile of the slope is not computed for rows that no turn's frame has."""
    df = _frame(spark)
    plan = deceleration_points(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("percentile(") < plan.index("Filter (__reached") if "Filter (__reached" in plan else plan.index("percentile(") < plan.rindex("< 20)")
