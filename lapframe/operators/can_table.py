"""CAN decoding as a table function for SQL.

``SELECT * FROM can_signals(TABLE(SELECT line_no AS row_id, can_id, is_extended, data FROM frames))``
gives row_id, message, signal, value and unit. Spark hands over Arrow batches of any partition; a batch is decoded
message by message over all its payloads at once. (Spark has no Arrow table functions to the
right of LATERAL, and one call per row would be the price of the others.) Rows are those of ``decode_long``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from lapframe.operators.can import Message, Signal

COLUMNS = ("row_id", "can_id", "is_extended", "data")
SCHEMA = "row_id long, message string, signal string, value double, unit string"


def payload_bytes(data: pa.Array, width: int) -> np.ndarray:
    """The first ``width`` bytes of each payload; all have so many."""
    whole = data.cast(pa.large_binary())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    held = whole.buffers()[2]
    return np.frombuffer(held, np.uint8)[offsets[:-1, None] + np.arange(width)] if width and held else np.empty((len(whole), width), np.uint8)


def signal_values(payloads: np.ndarray, s: Signal) -> np.ndarray:
    """A signal of all payloads: each byte's part masked and moved to its place. Beyond 64 bits in doubles."""
    parts = [((payloads[:, byte] >> low & mask).astype(np.uint64), mask, place) for byte, low, mask, place in s.shares()]
    if s.bit_length > 64:
        raw = sum(x.astype(float) * 2.0**place for x, _, place in parts)
        if s.signed:  # a negative number by its complement, which keeps small ones exact
            top, mask, _ = max(parts, key=lambda part: part[2])
            raw = np.where(top * 2 > mask, -1.0 - sum((mask - x).astype(float) * 2.0**place for x, mask, place in parts), raw)
    else:
        bits = np.zeros(len(payloads), np.uint64)
        for x, _, place in parts:
            bits |= x << np.uint64(place)
        unused = 64 - s.bit_length
        raw = ((bits << np.uint64(unused)).view(np.int64) >> unused if s.signed else bits).astype(float)
    return raw * float(s.factor) + float(s.offset)


def decode_batch(batch: pa.RecordBatch | pa.Table, known: dict[tuple[int, bool], Message]) -> Iterator[pa.Table]:
    """The signals of one batch's known frames. A payload too short for its message is an error; a frame without payload has NULL values."""
    row_id, can_id, extended, data = (batch.column(c) for c in COLUMNS)
    for held in pa.table([can_id, extended], ["id", "extended"]).group_by(["id", "extended"]).aggregate([]).to_pylist():
        m = known.get((held["id"], held["extended"]))
        if m is None or not m.signals:
            continue
        own = pc.fill_null(pc.and_(pc.equal(can_id, m.can_id), pc.equal(extended, m.extended)), False)
        rows, payloads = row_id.filter(own), data.filter(own)
        full = payloads.is_valid().to_numpy(zero_copy_only=False)
        there = payloads.drop_null()
        if (pc.min(pc.binary_length(there)).as_py() or 0) < m.bytes_needed() and len(there):
            raise ValueError(f"payload too short for message {m.name}")
        matrix = payload_bytes(there, m.bytes_needed())
        for s in m.signals:
            values = np.full(len(rows), np.nan)
            values[full] = signal_values(matrix, s)
            same = [pa.repeat(pa.scalar(x, pa.string()), len(rows)) for x in (m.name, s.name, s.unit)]
            yield pa.table([rows.cast(pa.int64()), same[0], same[1], pa.array(values, mask=~full), same[2]], ["row_id", "message", "signal", "value", "unit"])


def register_can_table(spark: SparkSession, messages: list[Message], name: str = "can_signals") -> None:
    """Give SQL the table function ``name`` with these definitions."""
    known = {(m.can_id, m.extended): m for m in messages}

    @arrow_udtf(returnType=SCHEMA)
    class CanSignals:
        def eval(self, frames):
            yield from decode_batch(frames, known)

    spark.udtf.register(name, CanSignals)
