"""Streams: live CAN lines, changed payloads, a lap counter, and windows over events.

What depends on the order of a key's rows takes them by event time (:class:`InOrder`): a row waits in
the key's state until the watermark has passed it, rows that come later than that are dropped by Spark, and a
key without rows for ``idle`` is closed and leaves the state. A row without a key or a place in the order only tells the time,
so that keys can end when nothing else comes. These operators need the RocksDB state
store (:func:`rocksdb_state`).

Rows travel to the state in blocks (:func:`_in_blocks`), and the keys of a bucket share one state, since rows and keys that go by themselves
cost most of the time. A block stays within one ``step`` of event time and has the time at which the step ends, so Spark drops it as late whole
or not at all. For that the watermark moves in whole steps, up to two steps after ``late``: no row is dropped that would not be without blocks.
A task holds the rows of one bucket that wait, so ``buckets`` should grow with what waits at once.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lapframe.operators.laps import JUMP_M, SETTLE_ROWS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def candump_stream(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """Lines of CAN logs as they are dropped into a folder: line, path."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("path"))


#: So many rows are made blocks of at once.
BLOCK_ROWS = 1 << 17
#: Columns of rows: key, event time (microseconds), order, values.
Rows = list[np.ndarray]


def _block(rows: Rows) -> bytes:
    return pickle.dumps(rows, protocol=5)


def _step_end(us, step: int):
    """The end of the step of time that ``us`` is in; the end belongs to the step."""
    return -(-us // step) * step


def _in_blocks(columns: list[str], step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: event_bucket, event_end, event_first, event_is_row, event_block: one row for the rows of a bucket and a step of time that a task reads together.

    ``columns`` are key, event time, order and values. Rows without key or order become one row that tells their last time.
    """

    def packed(rows: pa.Table) -> pa.RecordBatch:
        told = pc.and_(pc.is_valid(rows[columns[0]]), pc.is_valid(rows[columns[2]]))
        clock, rows = rows.filter(pc.invert(told))[columns[1]].to_numpy(), rows.filter(told)
        buckets, ends = rows["event_bucket"].to_numpy(), _step_end(rows[columns[1]].to_numpy(), step)
        place = np.lexsort((ends, buckets))
        buckets, ends, values = buckets[place], ends[place], [rows[c].to_numpy()[place] for c in columns]
        starts = np.flatnonzero(np.r_[True, (buckets[1:] != buckets[:-1]) | (ends[1:] != ends[:-1])][: len(place)])
        bounds, n = np.r_[starts, len(place)], len(starts)
        blocks = [_block([v[i:j] for v in values]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        firsts = np.minimum.reduceat(values[1], starts) if n else starts
        out = [buckets[starts].tolist(), ends[starts].tolist(), firsts.tolist(), [True] * n, blocks]
        if len(clock):
            last = _step_end(int(clock.max()), step)
            for column, x in zip(out, (0, last, last, False, None), strict=True):
                column.append(x)
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["event_bucket", "event_end", "event_first", "event_is_row", "event_block"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            kept.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield packed(pa.Table.from_batches(kept))
                kept, n = [], 0
        if n:
            yield packed(pa.Table.from_batches(kept))

    return pack


class InOrder(StatefulProcessor):
    """Each key's rows in the order of event time, then order; subclasses say what comes of them.

    They come as frames of ``columns`` (event time in microseconds, order, values) of one key, or of blocks of rows of a bucket of keys. What one call
    brings waits as one value beside its first time, since each value of a state goes by itself to Python and back; it is not read before one of its rows is due.
    """

    #: Names of the output's columns after the key.
    GIVES: tuple[str, ...]

    def __init__(self, columns: list[str], idle_ms: int, time_step: int = 1):
        self.columns, self.idle_ms, self.time_step = columns, idle_ms, time_step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.own = handle.getListState("waiting", "first long, rows binary"), handle.getValueState("own", "keys binary")

    def step(self, state: tuple | None, rows: Rows) -> tuple[tuple, list[np.ndarray]]:
        """A key's state after ``rows``, which follow those given before (state None: none), and the columns that they yield."""
        raise NotImplementedError

    def finish(self, state: tuple) -> list[np.ndarray] | None:
        """What the end of a key's rows yields."""
        return None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for part in rows:
            if "event_block" in part.columns:
                fresh += zip(part["event_first"].tolist(), part["event_block"].tolist(), strict=True)
            else:
                values = [part[c].to_numpy() for c in self.columns]
                fresh.append((int(values[0].min()), _block([np.full(len(part), key[0], object), *values])))
        return self._advance(fresh, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._advance([], timerValues)

    def _wake(self, us: int | None, timers: list[int]) -> None:
        """Come back once the rows of time ``us`` are due; a bucket has one timer, and none without anything that waits."""
        at = None if us is None else -(-_step_end(us, self.time_step) // 1000)
        for timer in timers:
            if timer != at:
                self.handle.deleteTimer(timer)
        if at is not None and at not in timers:
            self.handle.registerTimer(at)

    def _advance(self, fresh: list[tuple[int, bytes]], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        due = now * 1000 // self.time_step * self.time_step
        timers = list(self.handle.listTimers())
        first = min((part[0] for part in fresh), default=None)
        if first is not None and first > due and all(t > now for t in timers):  # none is due, nor anything that waits
            self.waiting.appendValue((first, pickle.dumps([part[1] for part in fresh])))
            if not timers or _step_end(first, self.time_step) < timers[0] * 1000:
                self._wake(first, timers)
            return
        held = [tuple(part) for part in self.waiting.get()] if timers else []
        got = self.own.get() if timers else None
        own = {} if got is None else pickle.loads(got[0])  # of each key: when it ends, its state
        out, rest = [], None
        blocks = [*(b for part in held for b in pickle.loads(part[1])), *(part[1] for part in fresh)]
        if blocks:
            known = [np.concatenate(c) for c in zip(*map(pickle.loads, blocks), strict=True)]
            rest = [c[known[1] > due] for c in known]
            known = [c[known[1] <= due] for c in known]
            codes, keys = pd.factorize(known[0])
            place = np.lexsort((known[2], known[1], codes))
            known = [c[place] for c in known]
            bounds = np.r_[0, np.cumsum(np.bincount(codes, minlength=len(keys)))]
            for k, i, j in zip(keys.tolist(), bounds[:-1], bounds[1:], strict=True):
                state, columns = self.step(own[k][1] if k in own else None, [c[i:j] for c in known])
                own[k] = (int(known[1][j - 1]) + self.idle_ms * 1000, state)
                out.append((k, columns))
        waits = set(rest[0].tolist()) if rest else set()
        for k in [k for k, (ends, _) in own.items() if k not in waits and _step_end(ends, self.time_step) <= due]:
            columns = self.finish(own.pop(k)[1])
            if columns is not None:
                out.append((k, columns))
        if waits:
            self.waiting.put([(int(rest[1].min()), pickle.dumps([_block(rest)]))])
        elif held:
            self.waiting.clear()
        if own:
            self.own.update((pickle.dumps(own),))
        elif got is not None:
            self.own.clear()
        self._wake(min([*(ends for k, (ends, _) in own.items() if k not in waits), *([int(rest[1].min())] if waits else [])], default=None), timers)
        if sizes := [len(columns[0]) for _, columns in out]:
            key = np.empty(len(out), object)
            key[:] = [k for k, _ in out]
            yield pd.DataFrame({"key": np.repeat(key, sizes), **{name: np.concatenate(c) for name, c in zip(self.GIVES, zip(*[columns for _, columns in out], strict=True), strict=True)}})


#: Key types that go through NumPy as they are; others go as text.
_PLAIN = ("tinyint", "smallint", "int", "bigint", "string", "binary")


def _in_order(rows: DataFrame, key: str, time: str, order: str, values: list[str], late: str, kind: type[InOrder], idle: str, step: str, buckets: int, out: str) -> DataFrame:
    """key, and what ``kind`` gives (``out``: its columns and types)."""
    us, idle_ms = int(pd.Timedelta(step).total_seconds() * 1000) * 1000, int(pd.Timedelta(idle).total_seconds() * 1000)
    if us <= 0:
        raise ValueError(f"step of {step}: 1 millisecond at least")
    of_key = dict(rows.dtypes)[key]
    as_told, plain = (F.col(key), of_key) if of_key in _PLAIN else (F.col(key).cast("string"), "string")
    columns = ["event_us", "event_order", *values]
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("event_bucket")
    named = rows.select(bucket, as_told.alias("event_key"), F.unix_micros(time).alias("event_us"), F.col(order).cast("long").alias("event_order"), *values).where("event_us IS NOT NULL")
    blocks = named.mapInArrow(_in_blocks(["event_key", *columns], us), "event_bucket int, event_end long, event_first long, event_is_row boolean, event_block binary")
    told = blocks.withColumn("event_time", F.timestamp_micros("event_end")).withWatermark("event_time", f"{late} {us} microseconds")
    # the condition names the event time, so it stays behind the watermark, which also counts what it drops
    told = told.where(F.when(F.col("event_time").isNotNull(), F.col("event_is_row")).otherwise(F.lit(False))).select("event_bucket", "event_time", "event_first", "event_block")
    got = told.groupBy("event_bucket").transformWithStateInPandas(kind(columns, idle_ms, us), f"key {plain}, {out}", "Append", "EventTime")
    return got.withColumn("key", F.col("key").cast(of_key)).withColumnRenamed("key", key)


class _Changes(InOrder):
    """Rows whose payload differs from that of the row before."""

    GIVES = ("order", "data")

    def step(self, state: tuple | None, rows: Rows) -> tuple[tuple, list[np.ndarray]]:
        _, _, order, data = rows
        values = [None if state is None else state[0], *(b"" if d is None else bytes(d) for d in data)]
        changed = np.array([a != b for a, b in zip(values[1:], values[:-1], strict=True)], dtype=bool)
        return (values[-1],), [order[changed], data[changed]]


def changed_payloads(
    frames: DataFrame, key: str = "can_id", order: str = "line_no", time: str = "ts", payload: str = "data", late: str = "10 seconds", idle: str = "10 minutes", step: str = "1 second", buckets: int = 1024
) -> DataFrame:
    """key, order, payload of the frames whose payload differs from the one before with their key; after a pause of ``idle`` a key begins anew."""
    got = _in_order(frames, key, time, order, [payload], late, _Changes, idle, step, buckets, "order long, data binary")
    return got.select(key, F.col("order").alias(order), F.col("data").alias(payload))


class _Laps(InOrder):
    """Laps by the rule of :func:`slice_laps`: of falls less than 100 rows apart the last one begins a lap.

    Rows since a fall that is not settled are held, fewer than 100 of them.
    """

    GIVES = ("order", "s_m", "n_lap")

    def step(self, state: tuple | None, rows: Rows) -> tuple[tuple, list[np.ndarray]]:
        lap, last, place, fall, pending = state or (1, np.nan, 0, -1, None)
        _, _, order, s = rows
        with np.errstate(invalid="ignore"):
            falls = place + np.flatnonzero(np.diff(s, prepend=last) < -JUMP_M)
        begin, end, last = place, place + len(s), float(s[-1])
        if fall >= 0:
            begin, falls, order, s = fall, np.r_[fall, falls], np.r_[pending[0], order], np.r_[pending[1], s]
        counted = falls[np.diff(falls, append=end) >= SETTLE_ROWS]
        fall = int(falls[-1]) if len(falls) and end - falls[-1] < SETTLE_ROWS else -1
        n = fall - begin if fall >= 0 else end - begin
        laps = lap + np.searchsorted(counted, np.arange(begin, begin + n), side="right")
        return (lap + len(counted), last, end, fall, (order[n:], s[n:]) if fall >= 0 else None), [order[:n], s[:n], laps]

    def finish(self, state: tuple) -> list[np.ndarray] | None:
        lap, _, _, fall, pending = state
        return None if fall < 0 else [*pending, np.full(len(pending[0]), lap + 1)]


def lap_counter(samples: DataFrame, run: str = "run_id", order: str = "seq", time: str = "ts", late: str = "10 seconds", idle: str = "10 minutes", step: str = "1 second", buckets: int = 1024) -> DataFrame:
    """run_id, seq, s_m, n_lap as samples arrive, once each row's lap is certain.

    A run without samples for ``idle`` has ended: its last fall counts.
    """
    keyed = samples.withColumn("s_m", F.col("s_m").cast("double"))
    got = _in_order(keyed, run, time, order, ["s_m"], late, _Laps, idle, step, buckets, "order long, s_m double, n_lap int")
    return got.select(run, F.col("order").alias(order), "s_m", "n_lap")


def windowed_values(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event type and window; rows later than ``late`` are dropped once their window has closed."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    got = events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: stretches of events without a pause of ``gap``."""
    got = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def run_to_end(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All rows that a stream over what is there now gives, as a batch table (written to the shared folder, then read)."""
    from lapframe.session import shared_path

    spark = stream.sparkSession
    base = shared_path(spark, f"stream-{name}")
    if mode == "append":
        with rocksdb_state(spark):
            query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress
    return spark.read.schema(stream.schema).parquet(f"{base}/out/{last['batchId'] if last else 0}")
