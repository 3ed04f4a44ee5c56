"""Stateful streams against their batch forms: rows out of order, late ones, restarts, runs that end."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapframe.operators.laps import slice_laps
from lapframe.streaming.live import changed_payloads, lap_counter, rocksdb_state

BEGIN = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "run_id string, seq long, s_m double, ts timestamp"


def _samples(seed: int, n: int = 700):
    """Distances of one run at 10 Hz, with clusters of falls."""
    rng = np.random.default_rng(seed)
    s = np.cumsum(rng.uniform(0, 4, n))
    for at in sorted(rng.integers(5, n, 7)) + [n - 30, n - 10]:
        s[at:] -= rng.uniform(290, 900)
    return [(f"r{seed}", k, None if k % 97 == 5 else float(x), BEGIN + dt.timedelta(seconds=k / 10)) for k, x in enumerate(s)]


class Fed:
    """A stream over a folder; each call adds one file and runs what there is, from the checkpoint."""

    def __init__(self, spark, folder, schema, made):
        self.spark, self.folder, self.schema, self.made, self.n = spark, folder, schema, made, 0

    def give(self, rows) -> None:
        target = str(self.folder / "in")
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(target)
        stream = self.made(self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(target))
        with rocksdb_state(self.spark):
            query = stream.writeStream.format("parquet").option("path", str(self.folder / "out")).option("checkpointLocation", str(self.folder / "state")).trigger(availableNow=True).start()
        query.awaitTermination()

    def out(self):
        return self.spark.read.parquet(str(self.folder / "out"))


def _tick(seconds: float):
    return [("clock", None, None, BEGIN + dt.timedelta(seconds=seconds))]


def test_lap_counter_over_batches_and_restarts(spark, tmp_path):
    rows = [r for k in range(3) for r in _samples(k)]
    fed = Fed(spark, tmp_path, SCHEMA, lambda df: lap_counter(df, late="30 seconds", idle="5 minutes"))
    order = sorted(rows, key=lambda r: r[3] + dt.timedelta(seconds=float(np.random.default_rng(hash(r[:2]) % 1000).uniform(0, 15))))
    for part in np.array_split(np.arange(len(order)), 4):  # out of order by up to 15 s, within the 30 s allowed
        fed.give([order[k] for k in part])
    before = fed.out()
    assert 0 < before.count() < len(rows)
    late = ("r0", 1000, 5.0, BEGIN + dt.timedelta(seconds=1))
    fed.give([late, *_tick(1000)])
    fed.give(_tick(2000))
    want = slice_laps(spark.createDataFrame(rows, SCHEMA)).select("run_id", "seq", "s_m", "n_lap")
    got = fed.out().select("run_id", "seq", "s_m", "n_lap")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert want.agg(F.max("n_lap")).first()[0] > 3 and late[1] not in {r["seq"] for r in got.collect()}
    early = {(r["run_id"], r["seq"]): r["n_lap"] for r in before.collect()}
    assert all(r["n_lap"] == early[r["run_id"], r["seq"]] for r in got.collect() if (r["run_id"], r["seq"]) in early)


def test_a_run_that_pauses_ends(spark, tmp_path):
    fed = Fed(spark, tmp_path, SCHEMA, lambda df: lap_counter(df, late="1 second", idle="1 minute"))
    lap = lambda first, at, n=130: [("a", first + k, float(k % 100) * 10, BEGIN + dt.timedelta(seconds=at + k / 10)) for k in range(n)]
    fed.give(lap(0, 0))  # the fall at 100 is settled by no later row
    assert fed.out().count() < 130
    fed.give(_tick(500))
    assert {r["n_lap"] for r in fed.out().where("seq >= 100").collect()} == {2} and fed.out().count() == 130
    fed.give(lap(500, 600))
    fed.give(_tick(2000))
    assert sorted((r["n_lap"], r["count"]) for r in fed.out().where("seq >= 500").groupBy("n_lap").count().collect()) == [(1, 100), (2, 30)]


def test_changed_payloads_in_order(spark, tmp_path):
    schema = "can_id int, line_no long, ts timestamp, data binary"
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(0, 4)), k, BEGIN + dt.timedelta(seconds=k), None if k % 41 == 0 else bytes([int(rng.integers(0, 2))])) for k in range(300)]
    fed = Fed(spark, tmp_path, schema, lambda df: changed_payloads(df, late="60 seconds", idle="1 hour"))
    mixed = [rows[k] for k in np.argsort(np.arange(300) + rng.uniform(0, 40, 300))]
    for part in (mixed[:120], mixed[120:130], mixed[130:], [(9, None, BEGIN + dt.timedelta(days=1), None)]):
        fed.give(part)
    last, want = {}, set()
    for can_id, line, _, data in rows:
        if last.get(can_id) != (data or b""):
            want.add((can_id, line))
        last[can_id] = data or b""
    assert {(r["can_id"], r["line_no"]) for r in fed.out().collect()} == want and fed.out().count() == len(want)
    with pytest.raises(Exception, match="event_us|cannot|COLUMN"):
        changed_payloads(spark.createDataFrame(rows, schema).drop("ts")).schema  # event time is needed


def test_rows_of_a_call_wait_as_one_value():
    """And they are given in order once the watermark has passed them, however the calls had them."""
    import pandas as pd

    from lapframe.streaming.live import _Changes

    class Held(list):
        def get(self):
            return iter(self) if self.many else (self[0] if self else None)

        def put(self, values):
            self[:] = values

        def update(self, value):
            self[:] = [value]

        appendValue = list.append

    class Handle:
        def __init__(self):
            self.timers = []

        def _state(self, many):
            held = Held()
            held.many = many
            return held

        def getListState(self, *_):
            return self._state(True)

        def getValueState(self, *_):
            return self._state(False)

        def listTimers(self):
            return iter(self.timers)

        def deleteTimer(self, t):
            self.timers.remove(t)

        def registerTimer(self, t):
            self.timers.append(t)

    class Times:
        now = 0

        def getCurrentWatermarkInMs(self):
            return self.now

    kind, handle, times = _Changes(["us", "no", "data"], 1000), Handle(), Times()
    kind.init(handle)
    part = lambda at: iter([pd.DataFrame({"us": [t * 1000 for t in at], "no": at, "data": [bytes([t // 20]) for t in at]})])
    assert not list(kind.handleInputRows(("k",), part([50, 40, 30]), times)) and not list(kind.handleInputRows(("k",), part([20, 60]), times))
    assert len(kind.waiting) == 2 and handle.timers == [20]
    times.now = 45
    got = list(kind.handleExpiredTimer(("k",), times, None))
    assert got[0].order.tolist() == [20, 40] and len(kind.waiting) == 1 and handle.timers == [50]
    times.now = 5000
    assert [p.order.tolist() for p in kind.handleExpiredTimer(("k",), times, None)] == [[60]] and not kind.waiting
