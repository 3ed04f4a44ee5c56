"""Blocks of rows and shared states of the streams in order: the same rows as one by one, however they are cut."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from lapframe.operators.laps import JUMP_M, SETTLE_ROWS
from lapframe.streaming.live import _in_blocks, _Laps, lap_counter

COLUMNS = ["event_key", "event_us", "event_order", "s_m"]


class _State(list):
    def __init__(self, many: bool):
        super().__init__()
        self.many = many

    def get(self):
        return iter(self) if self.many else (self[0] if self else None)

    def put(self, values):
        self[:] = values

    def update(self, value):
        self[:] = [value]

    appendValue = list.append


class _Handle:
    """States and timers of one key; counts what would go to the state and back."""

    def __init__(self):
        self.timers, self.now, self.values = [], 0, []

    def getListState(self, *_):
        self.values.append(_State(True))
        return self.values[-1]

    def getValueState(self, *_):
        self.values.append(_State(False))
        return self.values[-1]

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.now


def _table(rows, bucket=0):
    got = pa.table({c: [r[k] for r in rows] for k, c in enumerate(COLUMNS)}, schema=pa.schema([("event_key", pa.string()), ("event_us", pa.int64()), ("event_order", pa.int64()), ("s_m", pa.float64())]))
    return got.append_column("event_bucket", pa.array([bucket] * len(rows), pa.int32()))


def _blocks(rows, step):
    return pa.Table.from_batches(list(_in_blocks(COLUMNS, step)(iter(_table(rows).to_batches(500))))).to_pandas()


def _plain(s):
    """Laps of one run, row by row."""
    falls = [k for k in range(1, len(s)) if s[k] is not None and s[k - 1] is not None and s[k] - s[k - 1] < -JUMP_M]
    count = [f for f, g in zip(falls, [*falls[1:], None], strict=True) if g is None or g - f >= SETTLE_ROWS]
    return [1 + sum(f <= k for f in count) for k in range(len(s))]


def _runs(seed: int, keys: int = 5, n: int = 900):
    rng = np.random.default_rng(seed)
    rows = []
    for key in range(keys):
        s = np.cumsum(rng.uniform(0, 4, n))
        for at in sorted(rng.integers(5, n, 9)):
            s[at:] -= rng.uniform(290, 900)
        rows += [(f"r{key}", k * 100_000, k, None if k % 97 == 5 else float(x)) for k, x in enumerate(s)]
    return rows


def test_rows_of_a_bucket_and_step_are_one_block():
    rows = _runs(1)
    got = _blocks([*rows, (None, 95_000_001, None, None), ("r1", 7, None, None)], 10_000_000)
    told = got[got.event_is_row]
    assert len(told) == 10 and sorted(told.event_end) == [k * 10_000_000 for k in range(10)]  # time 0 ends the step before
    assert got[~got.event_is_row].event_end.tolist() == [100_000_000]
    assert len(_blocks([(None, 5, 1, 2.0)], 1000)) == 1 and not len(_blocks([(None, 5, 1, 2.0)], 1000).query("event_is_row"))


@pytest.mark.parametrize("step", [1, 700_000, 10_000_000, 10**9])
def test_laps_of_a_bucket_do_not_depend_on_blocks(step):
    """Five runs share a state; their rows come mixed by up to 15 s, and the watermark moves between the calls."""
    rows = _runs(2)
    kind, handle = _Laps(COLUMNS[1:], 20_000, step), _Handle()
    kind.init(handle)
    rng = np.random.default_rng(3)
    mixed = [rows[k] for k in np.argsort([r[1] + rng.uniform(0, 15_000_000) for r in rows])]
    got, most = [], 0
    for part in np.array_split(np.arange(len(mixed)), 9):
        given = [mixed[k] for k in part]
        blocks = _blocks(given, step)
        got += kind.handleInputRows((0,), iter([blocks[:7], blocks[7:]]), handle)
        most = max(most, len(handle.timers))
        handle.now = max(0, max(r[1] for r in given) - 15_000_000 - 2 * step) // 1000
        while handle.timers and handle.timers[0] <= handle.now:
            got += kind.handleExpiredTimer((0,), handle, None)
    handle.now = 10**9
    while handle.timers:
        got += kind.handleExpiredTimer((0,), handle, None)
    assert most == 1 and not any(handle.values)
    got = pd.concat(got)
    for key in sorted({r[0] for r in rows}):
        run = got[got.key == key]
        assert run.order.tolist() == list(range(900))
        assert run.n_lap.tolist() == _plain([r[3] for r in rows if r[0] == key])


def test_keys_that_share_a_state_end_by_themselves():
    kind, handle = _Laps(COLUMNS[1:], 10_000), _Handle()
    kind.init(handle)
    fall = lambda key, at: [(key, (at + k) * 100_000, k, float(k % 60) * 10) for k in range(90)]
    assert not list(kind.handleInputRows((0,), iter([_blocks([*fall("a", 1), *fall("b", 500)], 1)]), handle))
    handle.now = 20_000  # a has ended, b waits
    got = pd.concat(kind.handleExpiredTimer((0,), handle, None))
    assert set(got.key) == {"a"} and got.n_lap.tolist() == [1] * 60 + [2] * 30 and len(handle.timers) == 1
    assert not list(kind.handleInputRows((0,), iter([_blocks(fall("a", 900), 1)]), handle))  # and begins anew
    handle.now = 10**6
    got = pd.concat(kind.handleExpiredTimer((0,), handle, None))
    assert got[got.key == "a"].n_lap.tolist() == got[got.key == "b"].n_lap.tolist() == [1] * 60 + [2] * 30
    assert not any(handle.values) and not handle.timers


def test_keys_of_other_types(spark, tmp_path):
    from lapframe.streaming.live import rocksdb_state

    schema = "run_id date, seq long, s_m double, ts timestamp"
    rows = spark.sql("SELECT date'2024-01-01' + CAST(r AS int) AS run_id, k AS seq, CAST(k % 120 AS double) * 10 AS s_m, timestamp_seconds(1704067200 + k) AS ts FROM (SELECT id % 3 AS r, id div 3 AS k FROM range(750))")
    path = str(tmp_path / "in")
    rows.write.parquet(path)
    spark.sql("SELECT CAST(NULL AS date) AS run_id, CAST(NULL AS bigint) AS seq, CAST(NULL AS double) AS s_m, timestamp'2024-01-03' AS ts").write.mode("append").parquet(path)
    stream = lap_counter(spark.readStream.schema(schema).parquet(path), late="1 hour", step="10 minutes", buckets=2)
    with rocksdb_state(spark):
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert dict(got.dtypes) == {"run_id": "date", "seq": "bigint", "s_m": "double", "n_lap": "int"}
    assert sorted(map(tuple, got.groupBy("n_lap").count().collect())) == [(1, 360), (2, 360), (3, 30)] and got.select("run_id").distinct().count() == 3


@pytest.mark.parametrize(("partitions", "batches"), [("20", 2), ("4", 3)])
def test_triggers_grow_with_the_shuffle_partitions(spark, tmp_path, partitions, batches):
    """20 files and the one that tells the time; each batch costs a task for each shuffle partition."""
    from lapframe.plans.queries import _told

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rows = spark.range(200).repartition(20).selectExpr("id", "timestamp_seconds(id) AS ts")
        query = _told(spark, rows, "ts", "told").writeStream.format("noop").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    told = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(told) == batches and sum(told) == 201
