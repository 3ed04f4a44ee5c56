"""Files with names of their own, and tyre curves."""

from __future__ import annotations

import csv
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapframe.operators.stiffness import fit_magic_formula, fit_tyre_curves, magic_formula
from lapframe.plans.queries import QUERIES
from lapframe.sources.sinks import write_lap_files, write_run_files

SF = "/root/testdata/sf0.001"


def _laps(spark):
    rows = [("a/1", k, k / 10, float(k % 50), 1 + k // 50, "x,\"y\"") for k in range(120)] + [("b", k, k * 0.5, float(k), 1, None) for k in range(2)]
    return spark.createDataFrame(rows, "run_id string, seq long, time_s double, s_m double, n_lap int, note string")


def _read(path):
    with open(path, newline="") as f:
        return list(csv.reader(f, escapechar="\\"))


def test_lap_files(spark, tmp_path):
    path = str(tmp_path / "laps")
    df = _laps(spark)
    write_lap_files(df.repartition(3), path)
    assert sorted(os.listdir(path)) == ["a_1_lap_1_4.9s.csv", "a_1_lap_2_4.9s.csv", "a_1_lap_3_1.9s.csv", "b_lap_1_0.5s.csv"]
    head, *rows = _read(f"{path}/a_1_lap_2_4.9s.csv")
    assert head == df.columns and [int(r[1]) for r in rows] == list(range(51, 99))  # without the lap's first and last row
    assert rows[0] == ["a/1", "51", "5.0999999999999996", "1.0000000000000000", "2", 'x,"y"']
    assert [r[1:3] for r in _read(f"{path}/b_lap_1_0.5s.csv")[1:]] == [["0", "0.0000000000000000"], ["1", "0.5000000000000000"]]
    with pytest.raises(FileExistsError):
        write_lap_files(df, path)
    write_lap_files(df.where("run_id = 'b'"), path, overwrite=True)
    assert os.listdir(path) == ["b_lap_1_0.5s.csv"]


def test_run_files_and_failures(spark, tmp_path):
    df, path = _laps(spark), str(tmp_path / "runs")
    write_run_files(df, path)
    assert sorted(os.listdir(path)) == ["a_1.csv", "b.csv"] and len(_read(f"{path}/a_1.csv")) == 121
    broken = df.withColumn("s_m", F.when((F.col("run_id") == "a/1") & (F.col("seq") == 110), F.raise_error("a task dies").cast("double")).otherwise(F.col("s_m")))
    with pytest.raises(Exception, match="a task dies"):
        write_run_files(broken, str(tmp_path / "none"))
    assert os.listdir(tmp_path / "none") == []  # neither files of the tasks that went well nor parts of the other
    os.symlink(path, tmp_path / "link")
    with pytest.raises(ValueError, match="symbolic link"):
        write_run_files(df, str(tmp_path / "link"), overwrite=True)
    assert sorted(os.listdir(path)) == ["a_1.csv", "b.csv"]


def test_tyre_curves_against_one_fit_each(spark):
    rng = np.random.default_rng(2)
    parts, known = [], {"a": (10.0, 1.6, 7000.0, 0.5), "b": (14.0, 1.4, 9000.0, -0.3), "c": (8.0, 1.9, 5000.0, 0.9)}
    for run, p in known.items():
        slip = rng.uniform(-0.2, 0.2, 800)
        parts.append(pd.DataFrame({"run_id": run, "slip": slip, "force": magic_formula(slip, *p) + rng.normal(0, 20, 800)}))
    df = spark.createDataFrame(pd.concat(parts)).unionByName(spark.createDataFrame([("a", None, 1.0), ("d", 0.1, None)], "run_id string, slip double, force double"))
    got = {r["run_id"]: r for r in fit_tyre_curves(df.repartition(6), ["run_id"]).collect()}
    assert set(got) == set(known)
    for part in parts:
        run = part.run_id.iloc[0]
        r = got[run]
        own = np.sqrt(np.mean((magic_formula(part.slip.to_numpy(), r["b"], r["c"], r["d"], r["e"]) - part.force) ** 2))
        one = np.sqrt(np.mean((magic_formula(part.slip.to_numpy(), *fit_magic_formula(part.slip.to_numpy(), part.force.to_numpy())) - part.force) ** 2))
        assert r["n"] == 800 and r["rmse"] == pytest.approx(own, rel=1e-6) and own < one * 1.001 and own < 22
        at = np.linspace(-0.2, 0.2, 101)  # several parameters give nearly one curve, so the curve is compared
        assert np.abs(magic_formula(at, r["b"], r["c"], r["d"], r["e"]) - magic_formula(at, *known[run])).max() < 30


def test_tyre_curves_query_finds_the_parameters(spark):
    got = QUERIES["tyre_curves"](spark, SF).collect()
    assert len(got) == 20
    for r in got:
        peak = 8000 if r["axle"] == "f" else 8800
        assert (r["b"], r["c"], r["d"]) == pytest.approx((12, 1.9, peak), rel=0.02) and abs(r["e"]) < 0.05 and r["rmse"] < 1


def test_short_series_need_no_rounds_and_long_ones_agree(spark, monkeypatch):
    from lapframe.operators import stiffness

    rng = np.random.default_rng(4)
    slip = rng.uniform(-0.2, 0.2, 900)
    rows = pd.DataFrame({"run_id": np.repeat(["a", "b"], [300, 600]), "slip": slip, "force": magic_formula(slip, 10.0, 1.6, 7000.0, 0.5) + rng.normal(0, 20, 900)})
    df = spark.createDataFrame(rows)
    rounds, calls = stiffness._fit_in_rounds, []
    monkeypatch.setattr(stiffness, "_fit_in_rounds", lambda *a: calls.append(1) or rounds(*a))
    short = {r["run_id"]: r for r in fit_tyre_curves(df, ["run_id"]).collect()}
    assert not calls
    mixed = {r["run_id"]: r for r in fit_tyre_curves(df, ["run_id"], alone=400).collect()}
    assert calls and set(mixed) == set(short) == {"a", "b"}
    for run, r in mixed.items():
        assert r["n"] == short[run]["n"] and r["rmse"] == pytest.approx(short[run]["rmse"], rel=1e-6)
