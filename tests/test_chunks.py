"""Runs cut into chunks give what one pass over them gives."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapframe.functions.kernels import Recursion, butterworth_lowpass, zero_phase
from lapframe.operators.chunks import lowpass, with_lookback
from lapframe.operators.stiffness import estimate_stiffness, stiffness


def _one_pass(b, a, x):
    """Forward and backward, sample by sample, with mirrored ends and settled states."""
    pad, n = 3 * len(a), len(a) - 1
    settled = Recursion(b, a).settled

    def go(x):
        s, out = [v * x[0] for v in settled] + [0.0], []
        for v in x:
            y = b[0] * v + s[0]
            s = [s[k + 1] + b[k + 1] * v - a[k + 1] * y for k in range(n)] + [0.0]
            out.append(y)
        return np.array(out)

    longer = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    return go(go(longer)[::-1])[::-1][pad:-pad]


@pytest.mark.parametrize("n", [16, 255, 256, 257, 3000])
def test_blocks_side_by_side(n):
    b, a = butterworth_lowpass(4, 0.04)
    x = np.cumsum(np.random.default_rng(n).normal(size=n))
    assert np.allclose(zero_phase(b, a, x), _one_pass(b, a, x), rtol=1e-9, atol=1e-9)


def test_echo_of_a_state():
    r = Recursion(*butterworth_lowpass(4, 0.1))
    for n in (1, 2, 3, 64, 100):
        for k in range(4):
            y, _ = r.run(np.zeros(n), np.eye(4)[k])
            assert np.allclose(r.echo(n)[:, k], r.run(y[::-1], np.zeros(4))[1], atol=1e-12)


def _frame(spark, runs: dict[str, np.ndarray], rate: float):
    parts = [pd.DataFrame({"run_id": k, "seq": np.arange(len(x)), "x": x, "y": x[::-1] * 2, "rate": rate}) for k, x in runs.items()]
    return spark.createDataFrame(pd.concat(parts))


@pytest.mark.parametrize("rows", [7, 100, 1 << 16])
def test_lowpass_in_chunks(spark, rows):
    rng = np.random.default_rng(1)
    runs = {f"r{n}": np.cumsum(rng.normal(size=n)) for n in (16, 17, 99, 100, 101, 707, 2500)} | {"short": np.ones(15)}
    runs["gap"] = np.where(np.arange(50) == 33, np.nan, 1.0)
    df = _frame(spark, runs, 40.0).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in "xy"})
    got = lowpass(df.repartition(5), ["x", "y"], ["run_id"], "rate", 2.0, rows=rows).toPandas().sort_values("seq")
    b, a = butterworth_lowpass(4, 2.0 / 20.0)
    for k, x in runs.items():
        own = got[got.run_id == k]
        assert len(own) == len(x)
        if k in ("short", "gap"):
            assert own.x.isna().all() and own.y.isna().all()
        else:
            assert np.allclose(own.x, _one_pass(b, a, x), rtol=1e-9, atol=1e-9) and np.allclose(own.y, _one_pass(b, a, x[::-1] * 2), rtol=1e-9, atol=1e-9)
    slow = lowpass(df.withColumn("rate", F.lit(3.0)), ["x"], ["run_id"], "rate", 2.0, rows=rows)
    assert slow.where("x IS NOT NULL").count() == 0 and slow.count() == df.count()
    assert lowpass(df.where("false"), ["x"], ["run_id"], "rate", 2.0, rows=rows).count() == 0


def test_lookback_holds_every_window(spark):
    from lapframe.functions.kernels import window_starts

    rng = np.random.default_rng(2)
    x = np.r_[np.cumsum(rng.normal(size=900)) * 0.004, np.full(800, 0.1), np.cumsum(rng.normal(size=700)) * 0.004]
    df = _frame(spark, {"a": x}, 1.0).withColumn("chunk", F.floor(F.col("seq") / 200).cast("long")).select("run_id", "chunk", "seq", "x")
    got = with_lookback(df, "x", 0.02, ["run_id"], block=16).toPandas()
    starts = window_starts(x, 0.02)
    for chunk, part in got.groupby("chunk"):
        own = part[part.own].seq.to_numpy()
        assert sorted(own) == list(range(chunk * 200, min(len(x), chunk * 200 + 200)))
        assert part.seq.min() <= max(0, starts[own.min()] - 2) and sorted(part.seq) == list(range(part.seq.min(), own.max() + 1))
        assert len(part) - len(own) <= own.min() - starts[own.min()] + 48


def test_stiffness_in_chunks(spark):
    rng = np.random.default_rng(3)
    parts, want = [], {}
    for run, n in (("a", 5000), ("b", 1203), ("c", 12)):
        t = np.arange(n) / 50
        slip = 0.03 * np.sin(t) + 0.02 * np.sin(2.3 * t) + np.where(np.arange(n) % 2000 > 1300, 0.0, 0.002 * rng.normal(size=n))
        slip = np.where((np.arange(n) > 2500) & (np.arange(n) < 3400), 0.011 + 1e-4 * np.sin(9 * t), slip)
        force = 8000 * np.sin(1.9 * np.arctan(12 * slip)) + rng.normal(size=n)
        parts.append(pd.DataFrame({"run_id": run, "seq": np.arange(n), "time_s": t, "alpha_f_rad": slip, "alpha_r_rad": slip * 0.7, "fy_f_N": force, "fy_r_N": force * 1.1, "note": "kept"}))
        if n > 15:
            rate = (n - 1) / t[-1]
            want[run] = stiffness(slip, force, rate), stiffness(slip * 0.7, force * 1.1, rate)
    df = spark.createDataFrame(pd.concat(parts))
    for rows in (300, 1024, 1 << 16):
        got = estimate_stiffness(df, rows=rows).toPandas().sort_values("seq")
        assert len(got) == len(pd.concat(parts)) and set(got.note) == {"kept"}
        for run, axles in want.items():
            own = got[got.run_id == run]
            for axle, (value, ratio) in zip("fr", axles, strict=True):
                assert np.allclose(own[f"cs_{axle}_Nprad"], value, rtol=1e-6, equal_nan=True)
                assert np.allclose(own[f"cs_ratio_{axle}"], ratio, rtol=1e-6, equal_nan=True)
        assert got[got.run_id == "c"].cs_f_Nprad.isna().all()


def test_short_runs_go_in_one_pass(spark, monkeypatch):
    from lapframe.operators import stiffness as module
    from lapframe.plans.telemetry import circuits

    df = circuits(spark, "/root/testdata/sf0.001").where("run_id < 3").where("run_id > 0 OR seq < 700").select("run_id", "seq", "time_s", "alpha_f_rad", "alpha_r_rad", "fy_f_N", "fy_r_N")
    chunks, calls = module._in_chunks, []
    monkeypatch.setattr(module, "_in_chunks", lambda *a: calls.append(1) or chunks(*a))
    whole = module.estimate_stiffness(df).toPandas().sort_values(["run_id", "seq"])
    assert not calls
    mixed = module.estimate_stiffness(df, rows=800).toPandas().sort_values(["run_id", "seq"])
    assert calls and len(whole) == len(mixed) and list(whole.columns) == list(mixed.columns)
    for c in ("cs_f_Nprad", "cs_r_Nprad", "cs_ratio_f", "cs_ratio_r"):
        assert np.allclose(whole[c], mixed[c], rtol=1e-6, equal_nan=True)
