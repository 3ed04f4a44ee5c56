"""MAT files (level 5): top-level N x 2 arrays of Unix seconds and values, as long rows.

A file is one small binary value to Spark and is taken apart inside a task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Type numbers of the format.
_NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_MATRIX, _COMPRESSED, _NUMERIC_CLASSES = 14, 15, range(6, 16)


def _elements(raw: bytes, order: str, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 8 <= len(raw):
        kind, size = struct.unpack_from(order + "II", raw, at)
        if kind >> 16:  # small element: four bytes of data in the tag
            yield kind & 0xFFFF, raw[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        yield kind, raw[at + 8 : at + 8 + size]
        at += 8 + (size if kind == _COMPRESSED else -(-size // 8) * 8)


def arrays_of(raw: bytes) -> Iterator[tuple[str, np.ndarray]]:
    """(name, array) of the real numeric matrices of two dimensions."""
    if len(raw) < 128 or raw[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a MAT file of level 5")
    order = "<" if raw[126:128] == b"IM" else ">"
    for kind, body in _elements(raw, order, 128):
        if kind == _COMPRESSED:
            (kind, body), *_ = _elements(zlib.decompress(body), order)
        if kind != _MATRIX:
            continue
        parts = list(_elements(body, order))
        flags = struct.unpack_from(order + "I", parts[0][1])[0]
        dims = np.frombuffer(parts[1][1], order + "i4")
        if flags & 0xFF in _NUMERIC_CLASSES and not flags & 0x800 and len(dims) == 2 and parts[3][0] in _NUMBERS:
            yield parts[2][1].decode("latin-1"), np.frombuffer(parts[3][1], order + _NUMBERS[parts[3][0]]).reshape(dims, order="F").astype(float)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in batches:
        for path, raw in zip(files["path"], files["content"], strict=True):
            run = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
            try:
                for name, x in arrays_of(raw):
                    if x.shape[1] == 2 and not name.startswith("__"):
                        yield pd.DataFrame({"path": path, "run_id": run, "seq": np.arange(len(x)), "time_s": x[:, 0], "channel": name, "value": x[:, 1], "problem": None})
            except Exception as e:  # a file that can't be read is told, and others go on
                yield pd.DataFrame({"path": [path], "run_id": [run], "seq": [None], "time_s": [None], "channel": [None], "value": [None], "problem": [f"{type(e).__name__}: {e}"]})


def read_mat(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, run_id, seq, time_s, channel, value, problem. Align with :func:`lapframe.operators.align.align_series`."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content").repartition("path")
    return files.mapInPandas(_read, "path string, run_id string, seq long, time_s double, channel string, value double, problem string")
