"""Figures of whole runs in derived channels: windows over the rows, which are read, dealt and ordered once."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lapframe.operators.derive import GROUPS, derive, register_channel
from lapframe.plans.queries import QUERIES

SCHEMA = "run_id string, seq long, time_s double, yaw_rate_radps double"


def test_yaw_acceleration_by_the_median_step(spark):
    rng = np.random.default_rng(4)
    want, rows = {}, []
    for run, n in (("a", 40), ("b", 7), ("single", 1)):
        time, yaw = np.cumsum(rng.choice([0.1, 0.1, 0.1, 0.7], n)), rng.normal(size=n)
        rows += [(run, k, float(time[k]), float(yaw[k])) for k in range(n)]
        want |= {(run, k): x for k, x in enumerate(np.gradient(yaw, float(np.median(np.diff(time)))))} if n > 1 else {(run, 0): None}
    rows += [(None, k, float(k), float(k)) for k in range(3)]
    got = derive(spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], SCHEMA).repartition(3))
    assert got.columns == ["run_id", "seq", "time_s", "yaw_rate_radps", "yaw_accel_radps2"]
    have = got.collect()
    assert len(have) == len(rows) and all(r["yaw_accel_radps2"] is None for r in have if r["run_id"] is None)
    for r in have:
        if r["run_id"] is not None:
            x = want[r["run_id"], r["seq"]]
            assert (x is None and r["yaw_accel_radps2"] is None) or abs(x - r["yaw_accel_radps2"]) < 1e-12


def test_all_channels_without_a_join_and_with_one_exchange(spark):
    """The rows with all their channels are neither joined nor ordered again, and the table is read once."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as on large tables
    try:
        plan = QUERIES["derive_all"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Join" not in plan and plan.count("FileScan") == 1
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("+- Sort ") == 2


def test_figures_whose_columns_are_derived_first(spark):
    before = list(GROUPS)
    try:
        register_channel("twice", ("time_s",), ("double_s",), lambda k: {"double_s": F.col("time_s") * 2})
        register_channel("share", ("double_s",), ("share",), lambda k: {"share": F.col("double_s") / F.col("longest")}, of_run=lambda df, k: df.withColumn("longest", F.expr(f"max(double_s) OVER (PARTITION BY {k.run})")))
        rows = spark.createDataFrame([("a", 0, 1.0, 0.0), ("a", 1, 4.0, 0.0), ("b", 0, 2.0, 0.0)], SCHEMA)
        got = derive(rows, only={"twice", "share"})
        assert got.columns[-2:] == ["double_s", "share"] and sorted((r["run_id"], r["share"]) for r in got.collect()) == [("a", 0.25), ("a", 1.0), ("b", 1.0)]
    finally:
        GROUPS[:] = before
