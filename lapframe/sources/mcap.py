"""MCAP logs: long rows, from tasks that each read some byte ranges of a file.

:func:`read_mcap` plans in a Spark job over the files: an indexed file's summary gives its
chunks, in groups; a file without an index is walked record by record, without decoding
messages, and cut into ranges at record boundaries, each with the schemas and channels known there. The units of both
kinds are then dealt out and decoded. In a chunk with topics that are not wanted, the chunk's
message index tells the places of the wanted messages, and only they are touched.

``spark.read.format("mcap").option("topics", "/a,/b").load(path)`` does the same with the
planning on the driver; ``spark.readStream.format("mcap")`` follows files of a folder
as they come and grow (:class:`McapStream`). Files are opened by URI, local or remote.
"""

from __future__ import annotations

import json
import logging
import pickle
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lapframe.session import materialize
from lapframe.sources.files import open_file
from lapframe.sources.ros_messages import decode, definitions, leaves

SCHEMA = "path string, run_id string, channel string, time_s double, value double, log_time_ns long, chunk_offset long, message_offset long, problem string"
#: Uncompressed bytes per partition.
TASK_BYTES = 32 << 20
_ROWS = 20_000
MOST_TASKS = 10_000

log = logging.getLogger(__name__)

# The format's magic and record kinds.
MAGIC = b"\x89MCAP0\r\n"
FOOTER, SCHEMA_RECORD, CHANNEL, MESSAGE, CHUNK, MESSAGE_INDEX, CHUNK_INDEX, DATA_END = 0x02, 0x03, 0x04, 0x05, 0x06, 0x07, 0x08, 0x0F


@dataclass
class Unit(InputPartition):
    """Byte ranges of one file for one task: (offset, length, where the chunk's message index is, its length) of chunks, or one range of records."""

    path: str
    ranges: tuple[tuple[int, int, int, int], ...]
    schemas: dict
    channels: dict
    problem: str | None = None


class Cursor:
    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw, at

    def take(self, code: str):
        (value,) = struct.unpack_from("<" + code, self.raw, self.at)
        self.at += struct.calcsize("<" + code)
        return value

    def blob(self, code: str = "I") -> bytes:
        n = self.take(code)
        self.at += n
        return self.raw[self.at - n : self.at]

    def text(self) -> str:
        return self.blob().decode()


def records(raw: bytes, at: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(kind, offset, body) of the records in ``raw``."""
    while at + 9 <= len(raw):
        kind, size = struct.unpack_from("<BQ", raw, at)
        if at + 9 + size > len(raw):
            raise ValueError("a record goes past the end")
        yield kind, at, raw[at + 9 : at + 9 + size]
        at += 9 + size


def streamed(f, at: int, end: int, step: int = 8 << 20) -> Iterator[tuple[int, int, bytes]]:
    """The same over a file's bytes from ``at`` to ``end``, some at a time: a record and what was read with it are held."""
    held, first = b"", at  # ``held``: the bytes from ``first`` on
    while at + 9 <= end:
        here = at - first
        need = 9 + struct.unpack_from("<Q", held, here + 1)[0] if here + 9 <= len(held) else 9
        if at + need > end:
            raise ValueError("a record goes past the end")
        if here + need > len(held):
            rest = held[here:]
            held, first = rest + f.read_at(min(max(step, need - len(rest)), end - at - len(rest)), at + len(rest)), at
            if len(held) < need and at + len(held) < end:
                raise ValueError("the file ends early")
            continue
        yield held[here], at, held[here + 9 : here + need]
        at += need


def _learn(kind: int, body: bytes, schemas: dict, channels: dict) -> None:
    c = Cursor(body)
    if kind == SCHEMA_RECORD:
        ident = c.take("H")
        schemas[ident] = (c.text(), c.text(), c.blob().decode("utf-8", "replace"))
    elif kind == CHANNEL:
        ident, schema = c.take("H"), c.take("H")
        channels[ident] = (c.text(), c.text(), schema)


def unpacked(body: bytes) -> bytes:
    """The records inside a chunk."""
    c = Cursor(body)
    _, _, size, _ = c.take("Q"), c.take("Q"), c.take("Q"), c.take("I")
    compression, raw = c.text(), c.blob("Q")
    if not compression:
        return raw
    if compression == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompress(raw, max_output_size=size)
    if compression == "lz4":
        return pa.input_stream(pa.BufferReader(raw), compression="lz4").read()
    raise ValueError(f"unknown compression {compression!r}")


def groups_of(chunks: list[tuple], target: int = TASK_BYTES) -> list[list[tuple]]:
    """Chunks (start time, end time, offset, length, size, ...) in groups of about ``target`` bytes that don't overlap in time, as (offset, length, ...)."""
    out: list[list[tuple]] = []
    held, latest = 0, -1
    for start, end, offset, length, size, *more in sorted(chunks, key=lambda c: (c[0], c[2])):
        if not out or (held >= target and start > latest):
            out.append([])
            held, latest = 0, -1
        out[-1].append((offset, length, *more))
        held, latest = held + size, max(latest, end)
    return out


def _is_wanted(topic: str, topics: set[str] | None) -> bool:
    return topics is None or topic in topics


def plan_file(path: str, topics: set[str] | None, target: int = TASK_BYTES) -> Iterator[Unit]:
    """The units of a file; what stops the plan is a unit with a problem."""
    try:
        with open_file(path) as f:
            n = f.size()
            if f.read_at(8, 0) != MAGIC:
                raise ValueError("not an MCAP file")
            tail = f.read_at(min(n, 37), max(0, n - 37))
            start = struct.unpack_from("<Q", tail, 9)[0] if tail.endswith(MAGIC) and tail[0] == FOOTER else 0
            schemas, channels, chunks = {}, {}, []
            for kind, _, body in records(f.read_at(n - 8 - start, start)) if start else ():
                if kind == CHUNK_INDEX:
                    c = Cursor(body)
                    head = [c.take("Q") for _ in range(4)]
                    own = c.blob()
                    index = dict(struct.unpack_from("<HQ", own, k) for k in range(0, len(own), 10))
                    index_length, _, _ = c.take("Q"), c.text(), c.take("Q")
                    chunks.append((head, index, index_length, c.take("Q")))
                else:
                    _learn(kind, body, schemas, channels)
            if not chunks:
                yield from Walk(path).units(f, n - 8, topics, target)
                return
        wanted = {k for k, (topic, *_) in channels.items() if _is_wanted(topic, topics)}
        useful = []
        for (first, last, offset, length), index, index_length, size in chunks:
            # chunks without a wanted channel are not read; one without an index of channels may hold any
            if not index or index.keys() & wanted:
                sparse = index_length > 0 and not index.keys() <= wanted
                useful.append((first, last, offset, length, size, min(index.values()) if sparse else 0, index_length if sparse else 0))
        for group in groups_of(useful, target):
            yield Unit(path, tuple(group), schemas, channels)
    except (ValueError, struct.error) as e:
        yield Unit(path, (), {}, {}, f"{type(e).__name__}: {e}")


class Walk:
    """A file's records in order, up to where it has got; channels are learned on the way, messages are passed over.

    A chunk is unpacked only if the message indexes behind it name a channel that is not known yet, or if there are none.
    """

    def __init__(self, path: str):
        self.path, self.at, self.ended = path, len(MAGIC), False
        self.schemas, self.channels = {}, {}

    def units(self, f, end: int, topics: set[str] | None = None, target: int = TASK_BYTES, whole: bool = True) -> Iterator[Unit]:
        """The ranges from here to ``end``; with ``whole`` a record that goes past it is a problem, else the walk stops before it."""
        start, known = self.at, (dict(self.schemas), dict(self.channels))
        held, first, chunk, seen = b"", self.at, None, set()
        while self.at + 9 <= end and not self.ended:
            here = self.at - first
            if not 0 <= here <= len(held) - 9:
                held, first, here = f.read_at(min(1 << 16, end - self.at), self.at), self.at, 0
            kind, size = struct.unpack_from("<BQ", held, here)
            if chunk is not None and kind != MESSAGE_INDEX:
                self._learn_chunk(f, chunk, seen)
                chunk = None
            if self.at + 9 + size > end:
                break
            if kind == DATA_END:
                self.ended = True
                break
            if self.at - start >= target and kind in (CHUNK, MESSAGE):
                yield Unit(self.path, ((start, self.at - start, 0, 0),), *known)
                start, known = self.at, (dict(self.schemas), dict(self.channels))
            if kind in (SCHEMA_RECORD, CHANNEL):
                _learn(kind, f.read_at(size, self.at + 9), self.schemas, self.channels)
            elif kind == CHUNK:
                chunk, seen = (self.at + 9, size), set()
            elif kind == MESSAGE_INDEX and chunk is not None:
                seen.add(struct.unpack("<H", f.read_at(2, self.at + 9))[0])
            self.at += 9 + size
        if chunk is not None:
            self._learn_chunk(f, chunk, seen)
        if self.at > start:
            yield Unit(self.path, ((start, self.at - start, 0, 0),), *known)
        if whole and not self.ended and self.at != end:
            yield Unit(self.path, (), {}, {}, "ValueError: a record goes past the end")

    def _learn_chunk(self, f, chunk: tuple[int, int], seen: set[int]) -> None:
        if not seen or not seen <= self.channels.keys():
            for kind, _, body in records(unpacked(f.read_at(chunk[1], chunk[0]))):
                _learn(kind, body, self.schemas, self.channels)


def indexed_places(index: bytes, wanted: set[int]) -> list[int]:
    """Where the wanted channels' messages are in a chunk, in order, from its message index records."""
    places = []
    for kind, _, body in records(index):
        if kind == MESSAGE_INDEX and struct.unpack_from("<H", body)[0] in wanted:
            size = struct.unpack_from("<I", body, 2)[0]
            places += [struct.unpack_from("<Q", body, at + 8)[0] for at in range(6, 6 + size, 16)]
    return sorted(places)


def picked(raw: bytes, places: list[int]) -> Iterator[tuple[int, int, bytes]]:
    """The records of a chunk at some places."""
    for at in places:
        kind, size = struct.unpack_from("<BQ", raw, at)
        if at + 9 + size > len(raw):
            raise ValueError("a record goes past the end")
        yield kind, at, raw[at + 9 : at + 9 + size]


def read_unit(unit: Unit, topics: set[str] | None) -> Iterator[pa.RecordBatch]:
    schema = _arrow_schema()
    rows: list[tuple] = []
    run = unit.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    trouble = lambda text: (unit.path, run, None, None, None, None, None, None, text)
    if unit.problem:
        yield _batch([trouble(unit.problem)], schema)
        return
    try:
        for topic, time, chunk, at, got in _messages(unit, topics):
            rows += [(unit.path, run, topic + name, time / 1e9, value, time, chunk, at, None) for name, value in got]
            if len(rows) >= _ROWS:
                yield _batch(rows, schema)
                rows = []
    except (ValueError, struct.error) as e:
        rows.append(trouble(f"{type(e).__name__}: {e}"))
    if rows:
        yield _batch(rows, schema)


def _messages(unit: Unit, topics: set[str] | None) -> Iterator[tuple]:
    schemas, channels = dict(unit.schemas), dict(unit.channels)
    readers: dict = {}

    def messages(found: Iterator[tuple[int, int, bytes]], chunk: int):
        for kind, offset, body in found:
            if kind in (SCHEMA_RECORD, CHANNEL):
                _learn(kind, body, schemas, channels)
            elif kind == CHUNK:
                yield from messages(records(unpacked(body)), offset)
            elif kind == MESSAGE:
                ident, _, time, _ = struct.unpack_from("<HIQQ", body)
                if ident not in channels:
                    raise ValueError(f"a message of channel {ident}, which is not known")
                topic, _, s = channels[ident]
                if not _is_wanted(topic, topics):
                    continue
                if ident not in readers:
                    root, _, text = schemas.get(s, ("", "", ""))
                    readers[ident] = (root, definitions(root, text))
                try:
                    yield topic, time, chunk, offset, list(leaves(decode(body[22:], *readers[ident]), ""))
                except (ValueError, struct.error, StopIteration, KeyError, IndexError) as e:
                    log.warning("%s: skipped a message of %s at %d: %r", unit.path, topic, offset, e)

    with open_file(unit.path) as f:
        for offset, length, index_at, index_length in unit.ranges:
            if index_length:
                wanted = {k for k, (topic, *_) in channels.items() if _is_wanted(topic, topics)}
                places = indexed_places(f.read_at(index_length, index_at), wanted)
                (_, _, body), *_ = records(f.read_at(length, offset))
                yield from messages(picked(unpacked(body), places), offset)
            else:
                yield from messages(streamed(f, offset, offset + length), 0)


class McapReader(DataSourceReader):
    def __init__(self, paths: list[str], topics: set[str] | None):
        self.paths, self.topics = paths, topics

    def partitions(self) -> list[Unit]:
        return [u for path in self.paths for u in plan_file(path, self.topics)]

    def read(self, partition: Unit) -> Iterator[pa.RecordBatch]:
        return read_unit(partition, self.topics)


class McapStream(DataSourceStreamReader):
    """Files of a folder as they come and grow, ``maxBytesPerTrigger`` of them at a time.

    An offset holds how far each file is read: a place between records, so what a recorder has written
    in part waits. Whatever lies between two offsets is read once, also after a restart. Spark asks for the next offset
    without telling the last one, so the folder ``progress`` keeps what was given out; without it, the first
    batch after a start holds all that is there. It belongs to the query's checkpoint: if it is lost, the query stops with an error.
    """

    def __init__(self, folder: str, topics: set[str] | None, most: int | None, progress: str | None):
        self.folder, self.topics, self.most, self.progress = folder, topics, most, progress
        self.walks: dict[str, Walk] = {}
        self.given: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        if self.given is None:
            self.given = self._recall()
        room, out = self.most if self.given is not None else None, dict(self.given or {})  # a first batch without knowing the last offset takes all
        for path in self._files():
            with open_file(path) as f:
                if f.size() < len(MAGIC) or f.read_at(8, 0) != MAGIC:
                    continue
                walk = self._walk(path, f, out.get(path, len(MAGIC)))
                before = walk.at
                for unit in walk.units(f, f.size(), self.topics, min(TASK_BYTES, room or TASK_BYTES), whole=False):
                    out[path] = unit.ranges[0][0] + unit.ranges[0][1]
                    if room is not None and out[path] - before >= room:
                        break
                if room is not None:
                    room -= out.get(path, before) - before
            if room is not None and room <= 0:
                break
        self.given = out
        self._remember(out)
        return out

    def partitions(self, start: dict, end: dict) -> list[Unit]:
        if back := [path for path, at in start.items() if end.get(path, 0) < at]:
            raise ValueError(f"the offset of {back[0]} goes back; the folder {self.progress} does not belong to this checkpoint")
        self.given = self.given or dict(end)
        units = []
        for path, to in sorted(end.items()):
            at = start.get(path, len(MAGIC))
            if to > at:
                with open_file(path) as f:
                    units += self._walk(path, f, at).units(f, to, self.topics, whole=False)
        return units

    def read(self, partition: Unit) -> Iterator[pa.RecordBatch]:
        return read_unit(partition, self.topics)

    def _walk(self, path: str, f, at: int) -> Walk:
        """A walk that stands at ``at``; channels that the file names before it are known."""
        walk = self.walks.get(path)
        if walk is None or walk.at > at:
            walk = Walk(path)
        if walk.at < at:
            for _ in walk.units(f, at, whole=False):
                pass
        self.walks[path] = found = Walk(path)
        found.at, found.schemas, found.channels = walk.at, dict(walk.schemas), dict(walk.channels)
        return walk

    def _files(self) -> list[str]:
        from pyarrow import fs

        system, inner, scheme = fs.LocalFileSystem(), self.folder.removeprefix("file://"), ""
        if "://" in self.folder and not self.folder.startswith("file:"):
            system, inner = fs.FileSystem.from_uri(self.folder)
            scheme = self.folder.split("://")[0] + "://"
        return sorted(scheme + i.path for i in system.get_file_info(fs.FileSelector(inner)) if i.path.endswith(".mcap"))

    def _store(self):
        from pyarrow import fs

        if "://" in self.progress and not self.progress.startswith("file:"):
            return fs.FileSystem.from_uri(self.progress)
        return fs.LocalFileSystem(), self.progress.removeprefix("file://")

    def _remember(self, offset: dict) -> None:
        if self.progress:
            system, inner = self._store()
            system.create_dir(inner, recursive=True)
            with system.open_output_stream(f"{inner}/offset.json") as f:
                f.write(json.dumps(offset).encode())

    def _recall(self) -> dict | None:
        if not self.progress:
            return None
        system, inner = self._store()
        try:
            with system.open_input_file(f"{inner}/offset.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return {}


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in SCHEMA.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class McapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mcap"

    def schema(self) -> str:
        return SCHEMA

    def _topics(self) -> set[str] | None:
        return set(self.options["topics"].split(",")) if self.options.get("topics") else None

    def reader(self, schema) -> McapReader:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return McapReader(paths, self._topics())

    def streamReader(self, schema) -> McapStream:
        most = self.options.get("maxBytesPerTrigger")
        return McapStream(self.options["path"], self._topics(), int(most) if most else None, self.options.get("progress"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(McapSource)


def read_mcap(spark: SparkSession, paths: list[str] | str, topics: list[str] | None = None, target: int = TASK_BYTES) -> DataFrame:
    """Long rows of MCAP logs, one per number of a message; ``problem`` names what stopped a file. Tasks read about ``target`` bytes each."""
    wanted, files = set(topics) if topics else None, [paths] if isinstance(paths, str) else paths

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for unit in plan_file(path, wanted, target):
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(unit)])], ["unit"])

    def decode_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.column("unit"):
                yield from read_unit(pickle.loads(unit.as_py()), wanted)

    listed = spark.createDataFrame([(p,) for p in files], "path string").repartition(min(len(files), MOST_TASKS) or 1)
    units = materialize(listed.mapInArrow(plan, "unit binary").withColumn("no", F.monotonically_increasing_id()), "mcap-units")
    return units.repartition(max(1, min(units.count(), MOST_TASKS)), "no").select("unit").mapInArrow(decode_units, SCHEMA)
