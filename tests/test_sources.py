"""Files of every kind, written here and read back."""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from lapframe.operators import can
from lapframe.operators.can import (
    DefinitionError, Signal, changed_frames, column_names, decode_long, decode_wide, frames_of, last_times, long_table, parse_definitions, parse_lines,
)
from lapframe.profiles import read_profiles, select_profile, unify
from lapframe.sources import mcap
from lapframe.sources.candump import read_lines, read_long
from lapframe.sources.csv_logs import read_laps, read_wide
from lapframe.sources.csv_logs import read_long as csv_long
from lapframe.sources.files import discover, read_folder
from lapframe.sources.mat import arrays_of, read_mat
from lapframe.sources.ros_messages import decode, definitions, leaves
from lapframe.sources.sinks import fingerprints, write_laps, write_runs
from lapframe.sources.trajectory import Trajectory, parse_spec, read_trajectory


# --- CAN -----------------------------------------------------------------------------------------


def test_bits_of_signals():
    assert Signal("a", 4, 8, little_endian=True).bits()[:5] == [(0, 4), (0, 5), (0, 6), (0, 7), (1, 0)]
    assert Signal("a", 7, 12, little_endian=False).bits() == [(1, b) for b in range(4, 8)] + [(0, b) for b in range(8)]
    assert Signal("a", 7, 512).bits()[-1] == (0, 7)  # Motorola order unless told otherwise, up to a whole FD payload
    for start, bits, little in ((510, 8, True), (504, 9, False), (0, 513, True), (-1, 1, True), (0, 0, True)):
        with pytest.raises(DefinitionError):
            Signal("a", start, bits, little)
    with pytest.raises(DefinitionError):
        Signal("a", 0, 8, factor=float("inf"))


def test_definitions_are_checked():
    one = {"canId": "0x10", "name": "m", "signals": []}
    assert parse_definitions({"params": [one]})[0].can_id == 16
    x = {"name": "x", "startBit": 7, "bitLength": 8}
    plain = parse_definitions({"params": [one | {"signals": [x]}]})[0].signals[0]
    assert (plain.little_endian, plain.signed, plain.factor, plain.offset, plain.unit) == (False, False, 1.0, 0.0, "")
    for wrong in ({"isSigned": "false"}, {"isLittleEndian": 1}, {"startBit": "7"}, {"bitLength": True}, {"factor": "2"}, {"name": " "}, {"postfixMetric": 3}, {"offset": float("nan")}):
        with pytest.raises(DefinitionError):
            parse_definitions({"params": [one | {"signals": [x | wrong]}]})
    for bad in (3, {"params": [3]}, {"params": [{"canId": 1, "name": "m"}]}, {"params": [one, one | {"canId": 2}]}, {"params": [one | {"signals": [x, x]}]}, {"params": [one | {"isExtendedFrame": "no"}]}):
        with pytest.raises(DefinitionError):
            parse_definitions(bad)
    for bad in ({}, {"params": [one, one]}, {"params": [one | {"canId": 0x2FFFFFFF}]}, {"params": [one | {"canId": "x"}]}, {"params": [one | {"isExtendedFrame": False, "canId": 0x800}]}):
        with pytest.raises(DefinitionError):
            parse_definitions(bad)


def _lines(spark, lines):
    return spark.createDataFrame([("log", k + 1, x) for k, x in enumerate(lines)], "run_id string, line_no int, line string")


def test_lines(spark):
    lines = ["(1.5) can0 123#0102", "can1 12345678#", "(2) 7FF##1AA", "(3.25) can0 100 [2] 01 FF", "(4) can0 100 [02] 01 FF", "", "  ", "nonsense", "can0 123#123", "can0 100 [3] 01 02", "can0 100#112233445566778899", "can0 800#00", "can0 FFF#"]
    got = [tuple(r) for r in parse_lines(_lines(spark, lines)).orderBy("line_no").select("ts", "interface", "can_id", "is_extended", "is_fd", "fd_flags", "data", "problem").collect()]
    assert got[0] == (1.5, "can0", 0x123, False, False, None, b"\x01\x02", None)
    assert got[1][2:] == (0x12345678, True, False, None, b"", None)
    assert got[2] == (2.0, None, 0x7FF, False, True, 1, b"\xaa", None)
    assert got[3][4] is False and got[3][6] == b"\x01\xff" and got[4][4] is True
    assert got[5][-1] is None and got[6][-1] is None
    assert [g[-1] for g in got[7:]] == ["not a frame", "odd number of hex digits", "length does not match the payload", "payload too long", "identifier out of range", "identifier out of range"]
    with pytest.raises(Exception, match=r"line \d+: "):
        frames_of(_lines(spark, lines)).collect()
    assert frames_of(_lines(spark, lines), strict=False).count() == 5


def _pack(signal: Signal, raw: int, size: int) -> bytes:
    data = bytearray(size)
    for k, (byte, bit) in enumerate(signal.bits()):
        data[byte] |= ((raw >> k) & 1) << bit
    return bytes(data)


@pytest.mark.parametrize("unrolled", [True, False])
def test_decode_round_trip(spark, monkeypatch, unrolled):
    monkeypatch.setattr(can, "UNROLLED", 10_000 if unrolled else 0)
    rng = np.random.default_rng(1)
    signals = [(0, 1, True), (3, 13, True), (0, 64, True), (7, 16, False), (12, 7, False), (7, 64, False), (20, 33, True), (63, 80, True), (71, 100, False), (130, 40, True)]
    lines, want, params = [], [], []
    for k, (start, bits, little) in enumerate(signals):
        for signed in (False, True):
            ident = 0x100 + 2 * k + signed
            params.append({"canId": ident, "name": f"m{ident}", "signals": [{"name": "x", "startBit": start, "bitLength": bits, "isLittleEndian": little, "isSigned": signed, "factor": 0.5, "offset": 1}]})
            for raw in (0, (1 << bits) - 1, 1 << (bits - 1), int(rng.integers(0, 2**62)) % (1 << bits)):
                signal = Signal("x", start, bits, little, signed)
                data = _pack(signal, raw, max(8, signal.bytes_used()[-1] + 1))
                lines.append(f"(1.0) can0 {ident:03X}{'#' if len(data) == 8 else '##0'}{data.hex().upper()}")
                want.append((raw - (1 << bits) if signed and raw >> (bits - 1) else raw) * 0.5 + 1)
    messages = parse_definitions({"params": params})
    frames = frames_of(_lines(spark, lines))
    got = [r["value"] for r in decode_long(frames, messages).orderBy("line_no").collect()]
    assert got == pytest.approx(want, rel=1e-15)
    wide = decode_wide(frames, messages).orderBy("line_no").toPandas()
    assert wide[list(column_names(messages).values())].bfill(axis=1).iloc[:, 0].tolist() == pytest.approx(want, rel=1e-15)
    assert long_table(decode_long(frames, messages)).first()["can_id"].startswith("0x")


def test_short_payload_and_names(spark):
    messages = parse_definitions({"params": [{"canId": 1, "name": "m", "signals": [{"name": "ts", "startBit": 8, "bitLength": 8}]}]})
    with pytest.raises(Exception, match="too short"):
        decode_long(frames_of(_lines(spark, ["1#00"])), messages).collect()
    assert column_names(messages, ("ts",)) == {("m", "ts"): "m.ts"}
    assert decode_long(frames_of(_lines(spark, ["2#00"])), messages).count() == 0


def test_repeated_payloads(spark):
    frames = frames_of(_lines(spark, ["(1) a 001#00", "(2) a 001#00", "(3) b 001#00", "(4) a 001#01", "(5) a 001#00", "(6) a 001##000"]))
    kept = changed_frames(frames)
    assert sorted(r["line_no"] for r in kept.collect()) == [1, 3, 4, 5, 6]
    assert last_times(frames).first()["ts"] == 6


def test_candump_file(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"(1) can0 001#05\r\n\n(2) can0 001#06\n(3) can0 001#0")
    (tmp_path / "b.log").write_bytes(b"(1) can0 001#07\n")
    got = sorted((r["run_id"], r["line_no"], r["line"]) for r in read_lines(spark, str(tmp_path)).collect())
    assert got == [("a", 1, "(1) can0 001#05"), ("a", 2, ""), ("a", 3, "(2) can0 001#06"), ("b", 1, "(1) can0 001#07")]
    (tmp_path / "d.json").write_text(json.dumps({"params": [{"canId": 1, "name": "m", "signals": [{"name": "x", "startBit": 7, "bitLength": 8}]}]}))
    rows = read_long(spark, [str(tmp_path / "a.log"), str(tmp_path / "b.log")], str(tmp_path / "d.json")).collect()
    assert sorted((r["run_id"], r["channel"], r["value"]) for r in rows) == [("a", "m.x", 5.0), ("a", "m.x", 6.0), ("b", "m.x", 7.0)]


def test_candump_ends_and_times(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"params": [{"canId": 1, "name": "m", "signals": [{"name": "x", "startBit": 7, "bitLength": 8}]}]}))
    (tmp_path / "a.log").write_bytes(b"(1) can0 001#05\n(2) can0 001#06\n(3) can0 001#06\n(9) can0 002#06\n(5) can0 001#06\n")
    (tmp_path / "b.log").write_bytes(b"(1) can0 001#05\n(2) can0 001#06\n")
    rows = read_long(spark, [str(tmp_path / "a.log"), str(tmp_path / "b.log")], str(tmp_path / "d.json")).collect()
    # a run whose last frames repeat keeps its length by a row with a time alone; frames that are not decoded don't count
    assert sorted((r["run_id"], r["time_s"], str(r["channel"]), r["value"] or 0.0) for r in rows) == [("a", 1.0, "m.x", 5.0), ("a", 2.0, "m.x", 6.0), ("a", 5.0, "None", 0.0), ("b", 1.0, "m.x", 5.0), ("b", 2.0, "m.x", 6.0)]
    (tmp_path / "c.log").write_bytes(b"can0 002#05\ncan0 001#05\n")
    with pytest.raises(Exception, match="line 2: a decoded frame needs a time"):
        read_long(spark, str(tmp_path / "c.log"), str(tmp_path / "d.json")).collect()
    rows, problems = read_folder(spark, str(tmp_path))
    assert rows is None and {r["path"].rsplit("/", 1)[-1] for r in problems.collect()} == {"a.log", "b.log", "c.log"}


def test_line_numbers_across_splits(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {k}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_lines(spark, str(tmp_path / "a.log"))
        assert lines.rdd.getNumPartitions() >= 1
        assert sorted((r["line_no"], r["line"]) for r in lines.collect()) == [(k + 1, f"line {k}") for k in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_text_and_both_separators(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time_s,driver,v\n0.0,ann,1\n0.1,ann,x\n")
    (tmp_path / "b.csv").write_text("time_s\tv,w\n0.5\t2,3\n0.6,4\t5\n")
    got = read_wide(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert dict(got.dtypes)["driver"] == "string" and dict(got.dtypes)["v"] == "double"
    rows = sorted((r["run_id"], r["seq"], r["time_s"], r["driver"], r["v"], r["w"]) for r in got.collect())
    assert rows == [("a", 0, 0.0, "ann", 1.0, None), ("a", 1, 0.1, "ann", None, None), ("b", 0, 0.5, None, 2.0, 3.0), ("b", 1, 0.6, None, 4.0, 5.0)]
    assert {r["channel"] for r in csv_long(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()} == {"v", "w"}


def test_lap_files_for_the_report(spark, tmp_path):
    (tmp_path / "laps").mkdir()
    for name, rows in (("lap_10.csv", "5.0,1\n5.5,2\n"), ("lap_2.csv", "7.0,3\n7.25,4\n"), ("lap_9.csv", "")):
        (tmp_path / "laps" / name).write_text("time_s,v\n" + rows)
    got = read_laps(spark, str(tmp_path))
    # numbered in natural order; the empty file keeps its number
    assert sorted((r["n_lap"], r["seq"], r["time_s"], r["v"]) for r in got.collect()) == [(1, 0, 0.0, 3.0), (1, 1, 0.25, 4.0), (3, 0, 0.0, 1.0), (3, 1, 0.5, 2.0)]
    with pytest.raises(Exception):
        read_laps(spark, str(tmp_path / "laps")).collect()


def test_damaged_mcap_is_left_out_whole(spark, tmp_path):
    topics = {"/a": [(k, _float(float(k))) for k in range(300)]}
    (tmp_path / "good.mcap").write_bytes(_mcap(topics, indexed=False))
    (tmp_path / "cut.mcap").write_bytes(_mcap(topics, indexed=False)[:-200])
    rows, problems = read_folder(spark, str(tmp_path))
    got = rows.orderBy("seq").collect()
    assert {r["run_id"] for r in got} == {"good"} and [r["value"] for r in got] == [float(k) for k in range(300)]
    assert [r["seq"] for r in got] == list(range(300))
    assert [r["path"].rsplit("/", 1)[-1] for r in problems.collect()] == ["cut.mcap"]


def test_bad_files_are_left_out_whole(spark, tmp_path):
    """One good and several bad files of each text kind: the good ones are read, each bad one is told with its first problem."""
    folder = tmp_path / "logs"
    folder.mkdir()
    (tmp_path / "d.json").write_text(json.dumps({"params": [{"canId": 1, "name": "m", "signals": [{"name": "x", "startBit": 7, "bitLength": 16}]}]}))
    (folder / "good.csv").write_text("time_s,a\n0,1\n1,2\n")
    (folder / "blank.csv").write_text("\n1,2\n")
    (folder / "twice.csv").write_text("time_s,a,a\n0,1,2\n")
    (folder / "good.log").write_bytes(b"(1) can0 001#0005\n\n(2) can0 001#0006\ncan0 002#00\n")
    (folder / "line.log").write_bytes(b"(1) can0 001#0005\n(2) nonsense\n(3) more\n")
    (folder / "short.log").write_bytes(b"(1) can0 001#0005\n(2) can0 001#06\n")
    (folder / "time.log").write_bytes(b"can0 001#0005\n")
    rows, problems = read_folder(spark, str(folder), definitions=str(tmp_path / "d.json"))
    assert sorted((r["run_id"], r["time_s"], r["value"]) for r in rows.collect()) == [("good", 0.0, 1.0), ("good", 1.0, 2.0), ("good", 1.0, 5.0), ("good", 2.0, 6.0)]
    told = {r["path"].rsplit("/", 1)[-1]: r["problem"] for r in problems.collect()}
    assert told.keys() == {"blank.csv", "twice.csv", "line.log", "short.log", "time.log"}
    assert told["line.log"].startswith("line 2: ") and "short" in told["short.log"] and "time" in told["time.log"] and told["blank.csv"] == "no header"
    with pytest.raises(ValueError, match="twice.csv: a column occurs twice"):
        read_wide(spark, [str(folder / "good.csv"), str(folder / "twice.csv")])


def test_records_are_read_some_at_a_time():
    class File:
        def __init__(self, raw: bytes):
            self.raw = raw

        def read_at(self, n: int, at: int) -> bytes:
            return self.raw[at : at + n]

    raw = mcap.MAGIC + b"".join(_record(k % 14 + 1, bytes(n)) for k, n in enumerate([0, 1, 700, 5, 3000, 0, 40]))
    for step in (1, 64, 1 << 20):
        assert list(mcap.streamed(File(raw), 8, len(raw), step)) == list(mcap.records(raw, 8))
    with pytest.raises(ValueError, match="past the end"):
        list(mcap.streamed(File(raw), 8, len(raw) - 10, 64))


# --- MCAP ----------------------------------------------------------------------------------------


def _text(x: str) -> bytes:
    return struct.pack("<I", len(x)) + x.encode()


def _record(kind: int, body: bytes) -> bytes:
    return struct.pack("<BQ", kind, len(body)) + body


def _mcap(topics: dict[str, list[tuple[int, bytes]]], schema=("std_msgs/msg/Float64", "float64 data"), compression="zstd", indexed=True) -> bytes:
    head = [_record(mcap.SCHEMA_RECORD, struct.pack("<H", 1) + _text(schema[0]) + _text("ros2msg") + struct.pack("<I", len(schema[1])) + schema[1].encode())]
    head += [_record(mcap.CHANNEL, struct.pack("<HH", k, 1) + _text(t) + _text("cdr") + struct.pack("<I", 0)) for k, t in enumerate(topics, 1)]
    out = mcap.MAGIC + _record(0x01, _text("ros2") + _text("test"))
    chunks = b""
    for k, (_, messages) in enumerate(topics.items(), 1):
        inner = b"".join(head) + b"".join(_record(mcap.MESSAGE, struct.pack("<HIQQ", k, n, t, t) + data) for n, (t, data) in enumerate(messages))
        packed = zstandard.ZstdCompressor().compress(inner) if compression == "zstd" else inner
        times = [t for t, _ in messages]
        chunk = _record(mcap.CHUNK, struct.pack("<QQQI", min(times), max(times), len(inner), 0) + _text(compression) + struct.pack("<Q", len(packed)) + packed)
        chunks += _record(mcap.CHUNK_INDEX, struct.pack("<QQQQ", min(times), max(times), len(out), len(chunk)) + struct.pack("<IHQ", 10, k, 0) + struct.pack("<Q", 0) + _text(compression) + struct.pack("<QQ", len(packed), len(inner)))
        out += chunk
    out += _record(mcap.DATA_END, struct.pack("<I", 0))
    start = len(out) if indexed else 0
    if indexed:
        out += b"".join(head) + chunks
    return out + _record(mcap.FOOTER, struct.pack("<QQI", start, 0, 0)) + mcap.MAGIC


def _float(x: float) -> bytes:
    return b"\x00\x01\x00\x00" + struct.pack("<d", x)


@pytest.mark.parametrize("compression", ["", "zstd"])
@pytest.mark.parametrize("indexed", [True, False])
def test_mcap(spark, tmp_path, compression, indexed):
    topics = {f"/synthetic/{c}": [(k * 10**8, _float(k + n)) for k in range(20)] for n, c in enumerate(("vx_mps", "s_m"))}
    (tmp_path / "run.mcap").write_bytes(_mcap(topics, compression=compression, indexed=indexed))
    got = mcap.read_mcap(spark, str(tmp_path / "run.mcap"))
    assert got.where("problem is not null").count() == 0
    rows = sorted((r["channel"], r["time_s"], r["value"]) for r in got.collect())
    assert rows == sorted((f"{t}/data", k / 10, float(k + n)) for n, t in enumerate(topics) for k in range(20))
    assert {r["channel"] for r in mcap.read_mcap(spark, str(tmp_path / "run.mcap"), ["/synthetic/s_m"]).collect()} == {"/synthetic/s_m/data"}


def test_mcap_damage(spark, tmp_path):
    whole = _mcap({"/a": [(1, _float(1.0)), (2, b"\x00\x01")]})
    (tmp_path / "short.mcap").write_bytes(_mcap({"/a": [(1, _float(1.0))]}, indexed=False)[:-60])
    (tmp_path / "other.mcap").write_bytes(b"something else")
    (tmp_path / "good.mcap").write_bytes(whole)
    rows = mcap.read_mcap(spark, [str(tmp_path / n) for n in ("short.mcap", "other.mcap", "good.mcap")]).collect()
    assert {r["run_id"] for r in rows if r["problem"]} == {"short", "other"}
    assert [r["value"] for r in rows if r["run_id"] == "good"] == [1.0]  # the cut message is skipped


def _busy_mcap(n: int, indexed: bool, chunked: bool = True, mangled: bool = False, later: int = 0) -> bytes:
    """Two topics side by side, ``n`` messages each; in chunks of 50 with message indexes, or without chunks. ``mangled``: the second topic's records are too long."""
    kind = lambda k: (_record(mcap.SCHEMA_RECORD, struct.pack("<H", k) + _text("std_msgs/msg/Float64") + _text("ros2msg") + _text("float64 data")), _record(mcap.CHANNEL, struct.pack("<HH", k, k) + _text(f"/t{k}") + _text("cdr") + struct.pack("<I", 0)))
    out, index, held, places, known = mcap.MAGIC + _record(0x01, _text("ros2") + _text("test")), b"", b"", {}, set()

    def close():
        nonlocal out, index, held, places
        chunk = _record(mcap.CHUNK, struct.pack("<QQQI", 0, n, len(held), 0) + _text("") + struct.pack("<Q", len(held)) + held)
        at, own, offsets = len(out), b"", b""
        for k, entries in places.items():
            offsets += struct.pack("<HQ", k, at + len(chunk) + len(own))
            own += _record(mcap.MESSAGE_INDEX, struct.pack("<HI", k, 16 * len(entries)) + b"".join(struct.pack("<QQ", *e) for e in entries))
        index += _record(mcap.CHUNK_INDEX, struct.pack("<QQQQ", 0, n, at, len(chunk)) + struct.pack("<I", len(offsets)) + offsets + struct.pack("<Q", len(own)) + _text("") + struct.pack("<QQ", len(held), len(held)))
        out, held, places = out + chunk + own, b"", {}

    for i in range(n):
        for k in (1, 2):
            record = b"".join(kind(k)) if k not in known else b""
            known.add(k)
            at = len(held) + len(record)
            record += _record(mcap.MESSAGE, struct.pack("<HIQQ", k, i, i, i) + _float(i * 10.0 + k))
            if mangled and k == 2:
                record = record[: at - len(held) + 1] + struct.pack("<Q", 10**9) + record[at - len(held) + 9 :]
            if chunked:
                places.setdefault(k, []).append((i, at))
                held += record
            else:
                out += record
        if chunked and i % 50 == 49:
            close()
    if held:
        close()
    if later:
        return out[:later]
    out += _record(mcap.DATA_END, struct.pack("<I", 0))
    start = len(out) if indexed else 0
    if indexed:
        out += b"".join(b"".join(kind(k)) for k in (1, 2)) + index
    return out + _record(mcap.FOOTER, struct.pack("<QQI", start, 0, 0)) + mcap.MAGIC


def test_message_index_touches_wanted_messages_only(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a.mcap")
    (tmp_path / "a.mcap").write_bytes(_busy_mcap(120, indexed=True))
    touched = []
    monkeypatch.setattr(mcap, "decode", lambda raw, *types, f=mcap.decode: touched.append(raw) or f(raw, *types))
    walked = []
    monkeypatch.setattr(mcap, "records", lambda raw, at=0, f=mcap.records: (walked.append(x[0]) or x for x in f(raw, at)))
    (unit,) = mcap.plan_file(path, {"/t1"})
    walked.clear()
    rows = [r for b in mcap.read_unit(unit, {"/t1"}) for r in b.to_pylist()]
    assert [r["value"] for r in rows] == [i * 10.0 + 1 for i in range(120)] and len(touched) == 120
    assert walked.count(mcap.MESSAGE) == 0 and walked.count(mcap.MESSAGE_INDEX) == 6  # chunks are not walked, their indexes are
    monkeypatch.undo()
    (tmp_path / "a.mcap").write_bytes(_busy_mcap(120, indexed=True, mangled=True))  # walking such a chunk would fail
    got = mcap.read_mcap(spark, path, ["/t1"])
    assert sorted(r["value"] for r in got.collect()) == [i * 10.0 + 1 for i in range(120)]
    assert mcap.read_mcap(spark, path).where("problem IS NOT NULL").count() == 1


@pytest.mark.parametrize("chunked", [True, False])
def test_files_without_index_are_read_in_ranges(spark, tmp_path, chunked):
    path = str(tmp_path / "a.mcap")
    (tmp_path / "a.mcap").write_bytes(_busy_mcap(1000, indexed=False, chunked=chunked))
    units = list(mcap.plan_file(path, None, target=8_000))
    assert len(units) > 5 and all(u.channels for u in units[1:]) and not any(u.problem for u in units)
    ends = [(u.ranges[0][0], sum(u.ranges[0][:2])) for u in units]
    assert all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    got = mcap.read_mcap(spark, path, target=8_000)
    assert got.rdd.getNumPartitions() == len(units)
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r["channel"], r["value"]) for r in rows) == sorted((f"/t{k}/data", i * 10.0 + k) for i in range(1000) for k in (1, 2))
    assert len({r["task"] for r in rows}) > 3 and len({(r["chunk_offset"], r["message_offset"]) for r in rows}) == 2000
    one = mcap.read_mcap(spark, path)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, got.collect()))


def test_mcap_stream_gives_each_chunk_once(spark, tmp_path):
    """A file that grows and one that comes later, some bytes at a time, over restarts from the checkpoint."""
    mcap.register(spark)
    (tmp_path / "in").mkdir()
    whole = _busy_mcap(1000, indexed=True)

    def go(**options):
        stream = spark.readStream.format("mcap").options(progress=str(tmp_path / "progress"), **options).load(str(tmp_path / "in"))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
        query.stop()
        return sizes

    (tmp_path / "in" / "a.mcap").write_bytes(whole[: len(whole) // 3])
    first = go(maxBytesPerTrigger=10_000)
    assert len(first) > 2 and max(first) < 400
    (tmp_path / "in" / "a.mcap").write_bytes(whole)
    (tmp_path / "in" / "b.mcap").write_bytes(_busy_mcap(100, indexed=False, chunked=False))
    second = go(maxBytesPerTrigger=10_000)
    assert len(second) > 4 and max(second) < 400
    assert go() == []
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    want = [("a", f"/t{k}/data", i * 10.0 + k) for i in range(1000) for k in (1, 2)] + [("b", f"/t{k}/data", i * 10.0 + k) for i in range(100) for k in (1, 2)]
    assert sorted((r["run_id"], r["channel"], r["value"]) for r in rows) == sorted(want)


def test_chunk_groups():
    chunks = [(0, 10, 0, 5, 20), (10, 20, 5, 5, 20), (21, 30, 10, 5, 20), (31, 40, 15, 5, 20)]
    assert mcap.groups_of(chunks, 20) == [[(0, 5), (5, 5)], [(10, 5)], [(15, 5)]]
    assert mcap.groups_of([], 20) == []


def test_nested_messages():
    text = "Header header\ngeometry_msgs/Quaternion q\nfloat32[2] pair\nuint8[] list\nstring name\nbool ok\nint8 A=3\nfloat64[9] covariance\n" + "=" * 20 + "\nMSG: std_msgs/Header\nbuiltin_interfaces/Time stamp\nstring frame_id\n" + "=" * 20 + "\nMSG: geometry_msgs/Quaternion\nfloat64 x\nfloat64 y\nfloat64 z\nfloat64 w 1\n"
    types = definitions("my_msgs/msg/Thing", text)
    raw, at = bytearray(b"\x00\x01\x00\x00"), 0

    def put(code, *values):
        size = struct.calcsize("<" + code[-1])
        raw.extend(b"\0" * (-(len(raw) - 4) % size))
        raw.extend(struct.pack("<" + code, *values))

    put("i", 5), put("I", 6), put("I", 4), raw.extend(b"map\0")
    for v in (0.0, 0.0, np.sqrt(0.5), np.sqrt(0.5)):
        put("d", v)
    put("f", 1.5), put("f", 2.5), put("I", 3), raw.extend(b"\1\2\3")
    put("I", 2), raw.extend(b"n\0"), put("B", 1)
    for k in range(9):
        put("d", float(k))
    got = dict(leaves(decode(bytes(raw), "my_msgs/msg/Thing", types), ""))
    assert got["/q/yaw"] == pytest.approx(np.pi / 2) and got["/q/z"] == pytest.approx(np.sqrt(0.5))
    assert got["/pair/1"] == 2.5 and got["/list/2"] == 3 and got["/ok"] == 1
    assert not any("covariance" in k or "stamp" in k for k in got)


# --- MAT, CSV and others -------------------------------------------------------------------------


def _element(kind: int, data: bytes) -> bytes:
    return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)


def _matrix(name: str, x: np.ndarray) -> bytes:
    body = _element(6, struct.pack("<II", 6, 0)) + _element(5, np.array(x.shape, "<i4").tobytes()) + _element(1, name.encode()) + _element(9, x.astype("<f8").tobytes(order="F"))
    return _element(14, body)


def test_mat(spark, tmp_path):
    x = np.array([[1.0, 5.0], [2.0, 6.0], [2.0, 7.0]])
    packed = zlib.compress(_matrix("speed", x))
    raw = b"MATLAB".ljust(124) + b"\x00\x01IM" + struct.pack("<II", 15, len(packed)) + packed + _matrix("wide", np.ones((2, 3))) + _matrix("__own", x)
    assert [(n, a.shape) for n, a in arrays_of(raw)] == [("speed", (3, 2)), ("wide", (2, 3)), ("__own", (3, 2))]
    (tmp_path / "a.mat").write_bytes(raw)
    (tmp_path / "b.mat").write_bytes(b"bad")
    rows = read_mat(spark, str(tmp_path)).collect()
    assert sorted((r["run_id"], r["channel"], r["time_s"], r["value"]) for r in rows if not r["problem"]) == [("a", "speed", 1.0, 5.0), ("a", "speed", 2.0, 6.0), ("a", "speed", 2.0, 7.0)]
    assert [r["run_id"] for r in rows if r["problem"]] == ["b"]


def test_csv(spark, tmp_path):
    (tmp_path / "r2.csv").write_text("time_s,vx_mps,empty,name\n0.0,1.5,,a\n0.1,x,,b\n")
    (tmp_path / "r10.csv").write_text("time_s\tvx_mps\textra\n0.0\t3\t4\n")
    got = read_wide(spark, [str(tmp_path / "r2.csv"), str(tmp_path / "r10.csv")])
    assert set(got.columns) == {"run_id", "seq", "time_s", "vx_mps", "extra", "name"}
    assert sorted(tuple(r) for r in got.select("run_id", "seq", "time_s", "vx_mps").collect()) == [("r10", 0, 0.0, 3.0), ("r2", 0, 0.0, 1.5), ("r2", 1, 0.1, None)]
    (tmp_path / "notes.txt").write_text("no log")
    assert [r["run_id"] for r in discover(spark, str(tmp_path)).orderBy("natural_key").collect()] == ["r2", "r10"]
    whole, problems = read_folder(spark, str(tmp_path))
    assert whole.count() == 3 and problems.count() == 0


def test_profiles(spark, tmp_path):
    (tmp_path / "p.csv").write_text("target_name,one,conversion,two,conversion\nv,speed_kmh,0.5,velocity,\nt,clock,,time,\n")
    profiles = read_profiles(str(tmp_path / "p.csv"))
    assert [p.name for p in profiles] == ["one", "two"]
    assert select_profile(["velocity", "time"], profiles).name == "two" and select_profile(["time"], profiles) is None
    got = unify(spark.createDataFrame([(10.0, 1.0, 7)], "speed_kmh double, clock double, more int"), profiles[0])
    assert got.columns == ["v", "t", "more"] and tuple(got.first()) == (5.0, 1.0, 7)


def test_trajectory(spark, tmp_path):
    assert parse_spec('"a,b.csv",Run,#fff,1.5') == Trajectory("a,b.csv", "Run", "#fff", 1.5, 0.0)
    for bad in ("", "a,b,c,1,2,3", "a,b,c,x"):
        with pytest.raises(ValueError):
            parse_spec(bad)
    path = tmp_path / "t.csv"
    path.write_text("pos_x_m,pos_y_m\n1,2\n")
    assert tuple(read_trajectory(spark, Trajectory(str(path), "a", None, 10, 0)).first()) == ("a", None, 11.0, 2.0)
    path.write_text("pos_x_m,pos_y_m\n1,nan\n")
    with pytest.raises(Exception, match="finite"):
        read_trajectory(spark, Trajectory(str(path))).collect()


def test_sinks(spark, tmp_path):
    df = spark.range(40).select(F.lit("r").alias("run_id"), F.col("id").alias("seq"), (F.col("id") * 0.1).alias("time_s"), (F.col("id") % 20 * 1.0).alias("s_m"), (F.col("id") / 20).cast("int").alias("n_lap"))
    write_runs(df, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 40
    with pytest.raises(Exception, match="(?i)exists"):
        write_runs(df, str(tmp_path / "runs"))
    write_laps(df, str(tmp_path / "laps"), fmt="csv")
    back = spark.read.csv(str(tmp_path / "laps"), header=True)
    assert back.count() == 36 and {r["lap_time_s"] for r in back.select("lap_time_s").distinct().collect()} == {"1.9000000000000000"}
    one = fingerprints(df).first()["sha256"]
    assert fingerprints(df.repartition(3)).first()["sha256"] == one
    assert fingerprints(df.withColumn("s_m", F.when(F.col("seq") != 5, F.col("s_m")))).first()["sha256"] != one
    assert fingerprints(df.select("run_id", "seq", "time_s", "n_lap", "s_m")).first()["sha256"] != one
