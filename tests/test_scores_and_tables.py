"""Scores of fitted models, CAN decoding from SQL, and tables for combined plots."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapframe.operators.can import Message, Signal, decode_long
from lapframe.operators.can_table import register_can_table
from lapframe.operators.chunks import by_series, numbers
from lapframe.operators.plots import coloured_segments, combined_acceleration, numeric_channels
from lapframe.operators.scoring import LinearModel, Scaler, fit_linear, score
from lapframe.profiles import read_topics


def _rows(spark, n=400):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3)) * (1, 5, 0.1) + (0, 20, 1)
    y = x @ (2.0, -0.5, 7.0) + 3 + rng.normal(size=n) * 0.1
    held = [(k, *map(float, x[k]), float(y[k])) for k in range(n)] + [(n, None, 1.0, 1.0, 1.0), (n + 1, float("nan"), 1.0, 1.0, 1.0)]
    return x, y, spark.createDataFrame(held, "id long, a double, `b.c` double, d double, y double")


def test_linear_model_against_numpy(spark):
    x, y, df = _rows(spark)
    df = df.withColumn("flat", F.lit(4.0))
    features = ["a", "b.c", "d", "flat"]
    known = df.where("NOT isnan(a)")
    got = score(df, *fit_linear(known, features, "y"), features).orderBy("id").toPandas()
    design = np.c_[x, np.ones(len(x))]
    assert np.allclose(got.score[:-2], design @ np.linalg.lstsq(design, y, rcond=None)[0], rtol=1e-9)
    assert got.score[-2:].isna().all() and score(df.limit(0), LinearModel((1.0,), 0.0), None, ["a"]).columns == [*df.columns, "score"]
    with pytest.raises(ValueError, match="no rows"):
        fit_linear(df.limit(0), features, "y")


class Squares:
    def __init__(self, table):
        self.table = table

    def predict(self, x):
        return (x**2).sum(axis=1, keepdims=True)  # a column, as some libraries give


def test_any_model_and_its_size(spark):
    x, _, df = _rows(spark)
    got = score(df, Squares(None), Scaler((0.0, 20.0), (2.0, 0.0)), ["a", "b.c"], "sq").orderBy("id").toPandas()
    assert np.allclose(got.sq[:-2], (x[:, 0] / 2) ** 2 + (x[:, 1] - 20) ** 2)
    with pytest.raises(ValueError, match="more than"):
        score(df, Squares(np.zeros(1000)), None, ["a"], most_bytes=4000)


MESSAGES = [
    Message(1, "m", False, (Signal("u8", 0, 8, True), Signal("s12", 8, 12, True, True, 0.5, -1.0, "V"), Signal("big", 39, 16, False, True), Signal("all", 0, 64, True), Signal("neg", 0, 64, True, True))),
    Message(2, "wide", False, (Signal("w", 0, 100, True, True), Signal("v", 0, 100, True, False, 2.0))),
    Message(1, "ext", True, (Signal("bit", 3, 1, True),)),
    Message(5, "none", False, ()),
]


def test_table_function_gives_the_rows_of_decode_long(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k in range(3000):
        ident, extended = [(1, False), (2, False), (1, True), (5, False), (7, False)][k % 5]
        size = 8 if ident == 1 else 13
        rows.append((k, ident, extended, bytes(rng.integers(0, 256, size + (k % 3 if ident == 2 else 0), dtype=np.uint8)) if k % 50 else b"\xff" * size))
    frames = spark.createDataFrame(rows, "row_id long, can_id long, is_extended boolean, data binary").repartition(5)
    register_can_table(spark, MESSAGES, "signals_of")
    got = spark.sql("SELECT * FROM signals_of(TABLE(SELECT row_id, can_id, is_extended, data FROM {f}))", f=frames)
    key = ["row_id", "message", "signal"]
    a, b = (t.orderBy(*key).toPandas() for t in (got, decode_long(frames, MESSAGES).select(*got.columns)))
    assert len(a) == len(b) > 0 and (a[[*key, "unit"]] == b[[*key, "unit"]]).all().all() and np.allclose(a.value, b.value, rtol=1e-12)
    # beside other tables, like any relation of SQL
    joined = spark.sql("SELECT s.message, count(*) AS n FROM signals_of(TABLE(SELECT row_id, can_id, is_extended, data FROM {f})) s JOIN {f} f ON s.row_id = f.row_id GROUP BY 1", f=frames)
    assert {r["message"]: r["n"] for r in joined.collect()} == {"m": 3000, "wide": 1200, "ext": 600}
    none = spark.createDataFrame([(1, 1, False, None), (2, None, False, b"1"), (3, 1, None, b"1")], frames.schema)
    assert [r["value"] for r in spark.sql("SELECT * FROM signals_of(TABLE(SELECT * FROM {f}))", f=none).collect()] == [None] * 5
    assert spark.sql("SELECT * FROM signals_of(TABLE(SELECT * FROM {f}))", f=none.limit(0)).count() == 0
    short = spark.createDataFrame([(1, 1, False, b"123")], frames.schema)
    with pytest.raises(Exception, match="payload too short for message m"):
        spark.sql("SELECT * FROM signals_of(TABLE(SELECT * FROM {f}))", f=short).collect()


def test_groups_over_batches(spark):
    """Small groups share a batch, a large one goes over several; NULL is a key of its own, in any column."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(g, h, k) for g, h, n in [("a", 1, 1), ("a", None, 40), ("a", 2**60 + 1, 3), ("a", 2**60, 2), (None, 1, 8), (None, None, 5), ("", 1, 7)] for k in range(n)]
        df = spark.createDataFrame(rows, "g string, h long, k long").repartition(3)
        got = by_series(df, ["g", "h"], ["k"], lambda t: {"n": [len(t)], "in_order": [bool((numbers(t, "k") == np.arange(len(t))).all())]} if len(t) != 3 else None, {"n": "long", "in_order": "boolean"})
        found = {(r["g"], r["h"]): (r["n"], r["in_order"]) for r in got.collect()}
        assert found == {("a", 1): (1, True), ("a", None): (40, True), ("a", 2**60): (2, True), (None, 1): (8, True), (None, None): (5, True), ("", 1): (7, True)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_plot_tables(spark):
    rows = [(1, 1, k, float(s), float(v), a) for k, (s, v, a) in enumerate([(3, 30, 2.0), (1, 10, 0.0), (2, 20, None), (2, 21, 4.0)])] + [(1, 2, 4, 0.0, 5.0, 1.0), (1, 2, 5, 1.0, 6.0, 1.0), (1, 2, 6, None, 7.0, 1.0)]
    df = spark.createDataFrame(rows, "run_id long, n_lap int, seq long, s_m double, vx_mps double, a_total_mps2 double")
    got = [tuple(r)[2:] for r in coloured_segments(df).orderBy("n_lap", "x_from", "seq").collect()]
    assert got == [(1, 1.0, 10.0, 2.0, 20.0, 0.0, 0.0), (2, 2.0, 20.0, 2.0, 21.0, None, None), (3, 2.0, 21.0, 3.0, 30.0, 4.0, 1.0), (4, 0.0, 5.0, 1.0, 6.0, 1.0, 0.0)]
    assert [tuple(r) for r in combined_acceleration(df, 2).orderBy("seq").collect()] == [(1, 1, 1, 1.0, 1.0), (1, 2, 5, 1.0, 1.0), (1, 2, 6, None, 1.0)]
    assert numeric_channels(df.withColumn("t", F.lit("x")).withColumn("b", F.lit(True))) == df.columns


def test_topic_list(tmp_path):
    path = tmp_path / "topics.csv"
    path.write_text("/a/speed\n\n /b ,ignored\n/a/speed\n\"/c,d\"\n")
    assert read_topics(str(path)) == ["/a/speed", "/b", "/c,d"]


def test_derived_channels_are_compiled(spark):
    """One method for all channels would be over what the JVM compiles."""
    from lapframe.operators.derive import derive
    from lapframe.session import METHOD_BYTES, METHOD_LIMIT

    spark.conf.unset(METHOD_LIMIT)
    derive(spark.createDataFrame([("a", 0, 1.0, 2.0)], "run_id string, seq long, vx_mps double, vy_mps double"))
    assert int(spark.conf.get(METHOD_LIMIT)) <= METHOD_BYTES
