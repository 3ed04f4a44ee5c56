"""Alignment, smoothing, distance and report operators against NumPy and pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lapframe.functions.geo import checked_geographic, to_geographic, to_local
from lapframe.functions.nulls import clip, finite, finite_columns, ratio, unless_zero, where
from lapframe.functions.series import gradient, ordered
from lapframe.operators import report
from lapframe.operators.align import align_series, interpolate, mend_lap_starts, resample, time_grid
from lapframe.operators.derive import GROUPS, applies, derive, register_channel
from lapframe.operators.distance import debounced, nearest_distance, path_distance, reference_points
from lapframe.operators.laps import slice_laps
from lapframe.operators.smooth import read_filters, smooth, widths
from lapframe.vehicle import Tire, Vehicle, load_vehicle, vehicle_names


def test_null_policy(spark):
    df = spark.createDataFrame([(1.0, 0.0), (float("nan"), 2.0), (float("inf"), 1.0), (None, 3.0), (0.0, 4.0)], "a double, b double")
    got = df.select(
        finite("a").alias("finite"), ratio("b", "a").alias("ratio"), clip("a", -1, 0.5).alias("clip"),
        where(finite("a") >= 0, F.col("b")).alias("where"), unless_zero(finite("a"), finite("a") * 2).alias("unless"),
    ).collect()
    assert [r["finite"] for r in got] == [1.0, None, None, None, 0.0]
    assert got[0]["ratio"] == 0.0 and got[4]["ratio"] is None and got[0]["clip"] == 0.5 and got[3]["clip"] is None
    assert [r["where"] for r in got] == [0.0, 0.0, 0.0, 0.0, 4.0]
    assert [r["unless"] for r in got] == [2.0, None, None, None, 0.0]
    assert finite_columns(df).where("a is null").count() == 3


def test_interpolation_is_numpys(spark):
    r = np.random.default_rng(0)
    t, v = np.sort(r.uniform(0, 10, 40)), r.normal(size=40)
    knots = spark.createDataFrame([("a", "x", float(a), float(b)) for a, b in zip(t, v, strict=True)] + [("a", "y", 3.0, 7.0)], "run_id string, channel string, time_s double, value double")
    grid = time_grid(knots, 20.0)
    rows = interpolate(knots, grid).toPandas().sort_values(["channel", "seq"])
    want = t.min() + np.arange(int(np.ceil((t.max() - t.min()) * 20))) / 20
    x = rows[rows.channel == "x"]
    assert np.allclose(x.time_s, want) and np.allclose(x.value, np.interp(want, t, v))
    assert set(rows[rows.channel == "y"].value) == {7.0}


def test_resample_only_runs_with_holes(spark):
    rows = [("full", 0.3, 1.0, 5.0), ("full", 0.1, 2.0, 6.0), ("holes", 1.0, 1.0, None), ("holes", 1.25, None, 2.0), ("holes", 1.5, 3.0, 4.0), ("holes", 2.0, 5.0, None)]
    df = spark.createDataFrame(rows, "run_id string, time_s double, x double, s_m double")
    got = {(r["run_id"], r["seq"]): r for r in resample(df, ["x", "s_m"], 4.0).collect()}
    assert (got["full", 0]["time_s"], got["full", 0]["x"]) == (0.1, 2.0)
    assert [got["holes", k]["x"] for k in range(4)] == pytest.approx([1.0, 2.0, 3.0, 4.0]) and ("holes", 4) not in got
    assert [got["holes", k]["time_s"] for k in range(4)] == [0.0, 0.25, 0.5, 0.75]
    assert [got["holes", k]["s_m"] for k in range(4)] == [0.0, 2.0, 4.0, 4.0]


def test_alignment_of_series(spark):
    rows = [("a", "x", 0.0, 1.0, 0), ("a", "x", 1.0, 3.0, 1), ("a", "x", 1.0, 9.0, 2), ("a", "y", 0.5, 5.0, 0), ("a", "y", 0.8, 8.0, 1)]
    got = align_series(spark.createDataFrame(rows, "run_id string, channel string, time_s double, value double, seq long"), 2.0).collect()
    value = {(r["channel"], r["seq"]): r["value"] for r in got}
    assert [value["x", k] for k in range(3)] == [1.0, 2.0, 3.0]
    assert [value["y", k] for k in range(3)] == [None, 5.0, 8.0]


def test_lap_starts_and_laps(spark):
    s = [5.0, 6, 400, 390.5, 380, 0, 1]
    df = spark.createDataFrame([("a", k, float(x)) for k, x in enumerate(s)], "run_id string, seq long, s_m double")
    assert [r["s_m"] for r in mend_lap_starts(df).orderBy("seq").collect()] == [0.0, 6, 400, 390.5, 0, 0, 1]
    # falls at 50, 90 and 300: the first is less than 100 rows before the second
    far = np.arange(500.0) * 10
    for at in (50, 90, 300):
        far[at:] -= far[at]
        far[:at] += 1000
    got = slice_laps(spark.createDataFrame([("a", k, float(x)) for k, x in enumerate(far)], "run_id string, seq long, s_m double"))
    assert [r["seq"] for r in got.groupBy("n_lap").agg(F.min("seq").alias("seq")).orderBy("n_lap").collect()] == [0, 90, 300]
    assert slice_laps(spark.range(3).select(F.lit("a").alias("run_id"), F.col("id").alias("seq"))).where("n_lap <> 1").count() == 0


def test_smoothing(spark, tmp_path):
    assert widths({"a": 0.05, "b": 0.25, "c": 0.01, "d": 1.0}, 10, ["a", "b", "c"]) == {"b": 2}
    x = np.random.default_rng(1).normal(size=200)
    df = spark.createDataFrame([("a", k, k * 0.1, float(v)) for k, v in enumerate(x)] + [("b", k, k * 0.5, float(v)) for k, v in enumerate(x)], "run_id string, seq long, time_s double, x double")
    got = smooth(df, {"x": 2.0}).toPandas().sort_values(["run_id", "seq"])
    for run, n in (("a", 20), ("b", 4)):
        assert np.allclose(got[got.run_id == run].x_smoothed, pd.Series(x).rolling(n, center=True, min_periods=1).mean())
    (tmp_path / "f.csv").write_text("signal_name,window_length_s\nx,0.5\n")
    assert read_filters(str(tmp_path / "f.csv")) == {"x": 0.5}


def test_gradient_is_numpys(spark):
    x = np.random.default_rng(2).normal(size=50)
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)], "run_id string, seq long, x double")
    assert np.allclose(df.select(gradient("x", ordered(), 0.1).alias("g"), "seq").toPandas().sort_values("seq").g, np.gradient(x, 0.1))


def _circle(spark, run: str, n: int, noise: float = 0.0, step: float = 0.05):
    r = np.random.default_rng(3)
    a = np.arange(n) * step
    x, y = 60 * np.cos(a) + r.normal(scale=noise, size=n), 60 * np.sin(a) + r.normal(scale=noise, size=n)
    return spark.createDataFrame([(run, k, k * 0.1, float(p), float(q), float(60 * (b % (2 * np.pi)))) for k, (p, q, b) in enumerate(zip(x, y, a, strict=True))], "run_id string, seq long, time_s double, pos_x_m double, pos_y_m double, s_m double")


def test_nearest_points(spark):
    reference, run = _circle(spark, "ref", 126), _circle(spark, "b", 300, 4.0)
    away = spark.createDataFrame([("b", 900, 90.0, 5000.0, -3000.0, 0.0), ("b", 901, 90.1, None, 1.0, 0.0)], run.schema)
    run = run.unionByName(away)
    points = reference_points(reference, 10.0)
    got = nearest_distance(run, points, cell_m=3.0).toPandas().set_index("seq").s_norm_m
    p = points.toPandas().sort_values("ref_seq")
    for row in run.collect():
        if row["pos_x_m"] is None:
            assert np.isnan(got[row["seq"]])
            continue
        near = np.argsort(np.hypot(p.ref_x - row["pos_x_m"], p.ref_y - row["pos_y_m"]).to_numpy(), kind="stable")[:3]
        assert got[row["seq"]] == pytest.approx(p.ref_s.to_numpy()[near].mean())


def test_path_distance(spark):
    got = path_distance(_circle(spark, "a", 500).drop("s_m"), ((50.0, 1.0), (70.0, 1.0))).toPandas().sort_values("seq")
    resets = got.seq[got.s_m.diff() < 0].tolist()
    assert resets == [126, 252, 378] and got.s_m.max() == pytest.approx(2 * np.pi * 60, rel=0.01)
    assert path_distance(_circle(spark, "a", 50).drop("s_m"), ((50.0, 1.0), (70.0, 1.0))).where("s_m is not null").count() == 0
    with pytest.raises(ValueError):
        path_distance(_circle(spark, "a", 5), ((1.0, 1.0), (1.0, 1.0)))
    crossings = spark.createDataFrame([("a", k, t, 1) for k, t in enumerate([0.0, 3.0, 5.0, 9.9, 10.0])], "run_id string, seq long, time_s double, direction int")
    assert sorted(r["time_s"] for r in debounced(crossings).collect()) == [0.0, 5.0, 10.0]


def test_places(spark):
    lat, lon = to_geographic("x", "y", (48.0, 11.0))
    df = spark.createDataFrame([(100.0, -50.0)], "x double, y double").select("x", "y", lat.alias("lat"), lon.alias("lon"))
    x, y = to_local("lat", "lon", (48.0, 11.0))
    got = df.select(x.alias("bx"), y.alias("by"), checked_geographic(F.col("lat"), F.col("lon")).alias("ok")).first()
    assert (got["bx"], got["by"], got["ok"]) == (pytest.approx(100.0), pytest.approx(-50.0), True)
    for bad in ((91.0, 0.0), (0.0, 181.0), (float("nan"), 0.0)):
        with pytest.raises(ValueError):
            to_geographic("x", "y", bad)
    with pytest.raises(Exception, match="valid range"):
        df.select(checked_geographic(F.col("lat") + 90, F.col("lon"))).collect()


def test_groups_by_columns(spark):
    df = spark.createDataFrame([("a", 0, 10.0, 1.0)], "run_id string, seq long, vx_mps double, vy_mps double")
    assert {"v_mps", "beta_rad"} <= set(derive(df).columns)
    assert "v_mps" not in derive(df.drop("vy_mps")).columns
    kept = derive(df.withColumn("v_mps", F.lit(3.5))).first()
    assert kept["v_mps"] == 3.5  # what is there is not computed again
    assert not applies(GROUPS[2], ["vx_mps", "vy_mps", "v_mps"])
    register_channel("double_speed", ("v_mps",), ("double_mps",), lambda k: {"double_mps": F.col("v_mps") * 2})
    try:
        assert derive(df.withColumn("v_mps", F.lit(3.5))).first()["double_mps"] == 7.0
    finally:
        GROUPS.pop()


def test_loads_and_forces_are_balanced(spark):
    r = np.random.default_rng(5)
    rows = [("a", k, k * 0.1, *map(float, r.uniform(5, 40, 1)), *map(float, r.normal(size=4))) for k in range(50)]
    df = spark.createDataFrame(rows, "run_id string, seq long, time_s double, vx_mps double, vy_mps double, ax_mps2 double, ay_mps2 double, yaw_rate_radps double")
    car = Vehicle(wheelbase=2.8, distance_to_front_axle=1.3, mass=700.0, diff_cog_x=0.1)
    got = derive(df, car).toPandas()
    assert np.allclose(got.fz_fl_N + got.fz_fr_N, got.fz_f_N) and np.allclose(got.fz_rl_N + got.fz_rr_N, got.fz_r_N)
    assert np.allclose(got.fz_f_N + got.fz_r_N, 700 * 9.81 + 0.5 * 1.225 * 3.0 * got.v_mps**2)
    assert np.allclose(got.fy_N, 700 * got.ay_mps2)


def test_vehicle_files(spark, tmp_path):
    (tmp_path / "Car").mkdir()
    (tmp_path / "Car" / "vehicle_config.yaml").write_text("vehicle: {aero: {air_density: 1.2, lift_coeff: -2.0, cross_track_area: 1.1, diff_cog_x: 0.0}, dimension: {track_width_front: 1.5, track_width_rear: 1.4, wheelbase: 2.5, distance_to_front_axle: 1.2, cog_height: 0.4}, inertia: {yaw: 900.0}, mass: {total: 650}}")
    one = "{radius: {radius_20mps: 0.31, velocity_scaling: {velocity: [20.0, 40.0], factor: [1.0, 1.1]}}}"
    (tmp_path / "Car" / "tire_config.yaml").write_text("tires: {" + ", ".join(f"{k}: {one}" for k in ("front_left", "front_right", "rear_left", "rear_right")) + "}")
    assert vehicle_names(str(tmp_path)) == ["Car"]
    car = load_vehicle(str(tmp_path), "Car")
    assert car.mass == 650 and car.tires["rr"] == Tire(0.31, (20.0, 40.0), (1.0, 1.1))
    got = spark.createDataFrame([(10.0,), (30.0,), (50.0,)], "v double").select(car.tires["fl"].radius(F.col("v")).alias("r")).collect()
    assert [x["r"] for x in got] == pytest.approx([0.31, 0.31 * 1.05, 0.31 * 1.1])
    with pytest.raises(FileNotFoundError):
        vehicle_names(str(tmp_path / "Car"))


def test_report_texts(spark):
    df = spark.createDataFrame([(59.96,), (61.04,), (None,), (-1.0,)], "t double")
    assert [r[0] for r in df.select(report.lap_time_text(F.col("t"))).collect()] == ["1:00.0", "1:01.0", "--", "--"]
    df = spark.createDataFrame([(5.0,), (12000.0,), (1.5,)], "t double")
    assert [r[0] for r in df.select(report.scaled_time(F.col("t"))).collect()] == pytest.approx([0.05, 12.0, 1.5])


def test_scratch_tables_go(spark):
    import os

    from lapframe.session import materialize, scratch

    def paths(df):
        return {p.removeprefix("file:").removeprefix("//") for p in df.inputFiles()}

    with scratch(spark):
        gone = paths(materialize(spark.range(3), "gone"))
        kept = paths(materialize(spark.range(3), "kept", keep=True))
        assert all(map(os.path.exists, gone | kept))
    assert not any(map(os.path.exists, gone)) and all(map(os.path.exists, kept))


def test_nearest_distance_deals_no_row_by_itself(spark):
    """No join of the rows with what was found for them; rows without a place stay."""
    reference = spark.range(40).select(F.col("id").alias("ref_seq"), F.col("id").cast("double").alias("ref_x"), F.lit(0.0).alias("ref_y"), (F.col("id") * 2.0).alias("ref_s"))
    rows = spark.createDataFrame([("a", 0, 5.2, 0.5), ("a", 1, 300.0, 0.0), ("a", 2, None, 1.0)], "run_id string, seq long, pos_x_m double, pos_y_m double")
    got = nearest_distance(rows, reference, 3, cell_m=2.0)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {r.seq: r.s_norm_m for r in got.collect()} == {0: 10.0, 1: 76.0, 2: None}


def test_rows_are_dealt_by_their_number(spark):
    """More rows make more partitions, each series in one of them; few rows stay as they are."""
    from lapframe.session import dealt

    df = spark.range(1000).select((F.col("id") % 50).alias("run_id"), "id")
    many = dealt(df, "run_id", rows=50)
    assert many.rdd.getNumPartitions() == 20 and dealt(df, "run_id") is df
    homes = many.withColumn("home", F.spark_partition_id()).groupBy("run_id").agg(F.count_distinct("home").alias("n"))
    assert homes.where("n > 1").count() == 0


def test_no_step_before_the_deal_grows_with_the_grid(spark, monkeypatch):
    """First rows are dealt by their number, and a run's channels are found by hash, so grid rows are not sorted run by run."""
    from lapframe.operators import align
    from lapframe.session import dealt

    monkeypatch.setattr(align, "dealt", lambda df, *keys: dealt(df, *keys, rows=50))
    rows = [(f"r{k % 7}", "a", float(k // 14), float(k), k) for k in range(1000)]
    knots = spark.createDataFrame(rows, "run_id string, channel string, time_s double, value double, seq long")
    firsts = align.keep_first(knots, ["run_id", "channel", "time_s"], ["seq"])
    assert firsts._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and firsts.rdd.getNumPartitions() == 20
    assert {r.seq for r in firsts.collect()} == {k for k in range(1000) if k % 14 < 7}
    got = align.interpolate(knots, align.time_grid(knots, 1.0))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_grid_points_are_dealt_by_their_number(spark, monkeypatch):
    """Many points make more partitions than few, and are the same points."""
    from lapframe.operators import align

    knots = spark.createDataFrame([(f"r{k}", "a", float(t), 0.0, t) for k in range(40) for t in (0, 25)], "run_id string, channel string, time_s double, value double, seq long")
    few = align.time_grid(knots, 1.0)
    monkeypatch.setattr(align, "TASK_ROWS", 50)
    many = align.time_grid(knots, 1.0)
    assert many.rdd.getNumPartitions() == 20
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect())) and many.count() == 1000
