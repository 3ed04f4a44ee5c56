"""Every query with SQL against DuckDB on the smallest tables; every query without it runs and keeps its columns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapframe.plans.queries import ORACLES, QUERIES
from tests.compare import close, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF))
    assert rows
    if name in ORACLES:
        sql_columns, wanted = sql_rows(ORACLES[name], SF)
        assert columns == sql_columns and len(rows) == len(wanted)
        assert all(close(a, b) for x, y in zip(rows, wanted, strict=True) for a, b in zip(x, y, strict=True))


def test_entry_needs_no_llm(spark, monkeypatch):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert not entry._there("lapframe.gone.queries") and entry._there("lapframe.plans.queries")
    monkeypatch.setattr(entry, "_there", lambda module: False)
    assert set(entry.queries()) == set(QUERIES) and set(entry.oracle_sql()) == set(ORACLES)


def test_labels_and_slopes_of_laps_with_bends(spark):
    """Laps have corners of all phases (their SQL holds the labels), and slopes are near the tyre's own, as one pass over each run gives them."""
    from lapframe.operators.stiffness import stiffness
    from lapframe.plans.telemetry import circuits

    got = QUERIES["corner_labels"](spark, SF).toPandas()
    assert set(got.corner_name) > {"-", "T1", "T2", "T3"} and set(got.corner_phase) == {"-", "Braking", "Entry", "Mid", "Exit"}
    slopes = QUERIES["cornering_stiffness"](spark, SF).toPandas().sort_values("seq")
    known = slopes.cs_f_Nprad.dropna()
    assert len(known) > 0.9 * len(slopes) and 0.9 < known.quantile(0.99) / (8000 * 1.9 * 12) < 1.1  # the slope at no slip
    assert slopes.cs_ratio_f.dropna().max() <= 1 + 1e-9 and slopes.cs_ratio_f.min() < 0.8
    made = circuits(spark, SF).toPandas().sort_values("seq")
    for run, own in list(made.groupby("run_id"))[:3]:
        value, _ = stiffness(own.alpha_f_rad.to_numpy(), own.fy_f_N.to_numpy(), (len(own) - 1) / (own.time_s.iloc[-1] - own.time_s.iloc[0]))
        assert np.allclose(slopes[slopes.run_id == run].cs_f_Nprad, value, rtol=1e-6, equal_nan=True)


def test_lowpass_query(spark):
    from lapframe.functions.kernels import butterworth_lowpass, zero_phase
    from lapframe.plans.telemetry import runs

    got = QUERIES["lowpass_channels"](spark, SF).toPandas().sort_values("seq")
    made = runs(spark, SF).select("run_id", "seq", "time_s", "vx_mps").toPandas().sort_values("seq")
    assert len(got) == len(made)
    for run, own in made.groupby("run_id"):
        rate = (len(own) - 1) / (own.time_s.max() - own.time_s.min())
        want = zero_phase(*butterworth_lowpass(4, 1.0 / (rate / 2)), own.vx_mps.to_numpy())
        assert np.allclose(got[got.run_id == run].vx_mps, want, atol=1e-6)


@pytest.mark.parametrize("n_runs", [1, 2, 25])
def test_smoothing_with_any_number_of_rates(spark, n_runs):
    """Runs at rates of their own, odd and even widths, missing values: the mean of the rows around each; the same columns whatever the rates."""
    import math

    from lapframe.operators.smooth import smooth

    rows = [(run, k, k / (40.0 + 3 * run), float((k * 7 + run) % 23) if k % 11 else None) for run in range(n_runs) for k in range(150)]
    df = spark.createDataFrame(rows, "run_id int, seq int, time_s double, x double").withColumn("y", F.col("x") * 2)
    filters = {"x": 0.5, "y": 0.13, "time_s": 0.001, "gone": 1.0}
    got = smooth(df, filters)
    assert got.columns == [*df.columns, "x_smoothed", "y_smoothed", "time_s_smoothed"]
    found = {(r["run_id"], r["seq"]): r for r in got.collect()}
    assert len(found) == len(rows)
    for run in range(n_runs):
        own = [x for r, _, _, x in rows if r == run]
        for column, seconds, scale in (("x", 0.5, 1), ("y", 0.13, 2)):
            n = round(seconds * (40.0 + 3 * run))
            for k in range(150):
                near = [x * scale for x in own[max(0, k - n // 2) : k + n - n // 2] if x is not None]
                assert math.isclose(found[run, k][f"{column}_smoothed"], sum(near) / len(near), rel_tol=1e-12)
    assert all(r["time_s_smoothed"] is None for r in found.values())


def test_dropped_can_logs_as_a_stream(spark, tmp_path):
    from lapframe.operators.can import parse_lines
    from lapframe.streaming.live import candump_stream, run_to_end

    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.log").write_text(f"({k}.5) can0 12{k}#0{k}\n")
    frames = parse_lines(candump_stream(spark, str(tmp_path / "in"), files_per_batch=1)).select("ts", "can_id", "problem")
    assert sorted(tuple(r) for r in run_to_end(frames, "candump").collect()) == [(k + 0.5, 0x120 + k, None) for k in range(3)]


@pytest.mark.parametrize("name", ["can_decode_long", "can_decode_wide", "can_decode_table", "can_changes"])
def test_can_queries_hold_any_value(spark, tmp_path, name):
    """Larger tables hold values over 655.35, more than 16 bits of hundredths."""
    import duckdb

    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN -value WHEN event_id % 3 = 1 THEN 655.3 + value * 1000 ELSE value END AS value) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet'")
    columns, rows = spark_rows(QUERIES[name](spark, str(tmp_path)))
    sql_columns, wanted = sql_rows(ORACLES[name], str(tmp_path))
    assert columns == sql_columns and len(rows) == len(wanted)
    assert all(close(a, b) for x, y in zip(rows, wanted, strict=True) for a, b in zip(x, y, strict=True))
