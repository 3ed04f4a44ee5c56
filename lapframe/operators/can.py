"""CAN frames: from log lines to frames, without repeated payloads, to signals in long or wide form.

All of it is column expressions. A payload is read once, as words of 64 bits, and a
signal's bits are picked from them by shifts and masks. The signals of a small
definition database are plain expressions; those of a larger one (over
``UNROLLED`` signals) are looked up in a broadcast table of at most
``MOST_MESSAGES`` messages.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_MESSAGES = 65_536
MAX_ID, MAX_BITS = 0x1FFFFFFF, 512
#: So many signals are written out as expressions.
UNROLLED = 120

# The forms of a log line.
LINE = r"^\s*(?:\((-?\d+(?:\.\d+)?)\)\s+)?(?:(\S+)\s+)?"
COMPACT = LINE + r"([0-9A-Fa-f]{1,8})(##([0-9A-Fa-f])|#)([0-9A-Fa-f]*)\s*$"
CUT = "\u0001"
BRACKET = LINE + r"([0-9A-Fa-f]{1,8})\s+\[(\d{1,2})\]((?:\s+[0-9A-Fa-f]{2})*)\s*$"


class DefinitionError(ValueError):
    """A definition file that can't be used."""


@dataclass(frozen=True)
class Signal:
    name: str
    start_bit: int
    bit_length: int
    little_endian: bool = False
    signed: bool = False
    factor: float = 1.0
    offset: float = 0.0
    unit: str = ""

    def __post_init__(self):
        if not self.name or not 1 <= self.bit_length <= MAX_BITS or not 0 <= self.start_bit < MAX_BITS:
            raise DefinitionError(f"signal {self.name!r}: bad name or bit range")
        if max(self.bytes_used()) >= MAX_BITS // 8:
            raise DefinitionError(f"signal {self.name!r}: its bits go past {MAX_BITS}")
        if not (math.isfinite(self.factor) and math.isfinite(self.offset)):
            raise DefinitionError(f"signal {self.name!r}: factor and offset must be finite")

    def bits(self) -> list[tuple[int, int]]:
        """(byte, bit) from the least significant bit on."""
        if self.little_endian:
            return [divmod(self.start_bit + k, 8) for k in range(self.bit_length)]
        # big endian: from the most significant bit, down in a byte and on to the next byte's bit 7
        byte, bit, out = self.start_bit // 8, self.start_bit % 8, []
        for _ in range(self.bit_length):
            out.append((byte, bit))
            byte, bit = (byte, bit - 1) if bit else (byte + 1, 7)
        return out[::-1]

    def bytes_used(self) -> list[int]:
        return sorted({byte for byte, _ in self.bits()})

    def shares(self) -> list[tuple[int, int, int, int]]:
        """(byte, lowest bit, mask, place in the number) of each byte's part."""
        parts: dict[int, list[tuple[int, int]]] = {}
        for place, (byte, bit) in enumerate(self.bits()):
            parts.setdefault(byte, []).append((bit, place))
        return [(byte, min(own)[0], (1 << len(own)) - 1, min(p for _, p in own)) for byte, own in parts.items()]


@dataclass(frozen=True)
class Message:
    can_id: int
    name: str
    extended: bool
    signals: tuple[Signal, ...]

    def bytes_needed(self) -> int:
        return max((s.bytes_used()[-1] + 1 for s in self.signals), default=0)


def _field(held: dict, key: str, kinds: type | tuple[type, ...], what: str, default=None):
    """A field of the right kind: numbers are no texts, and truth values are no numbers."""
    value = held.get(key, default)
    if value is None and key not in held:
        raise DefinitionError(f"{what}: {key} is missing")
    if not isinstance(value, kinds) or isinstance(value, bool) and kinds is not bool:
        raise DefinitionError(f"{what}: {key} is {value!r}")
    return value


def _text(held: dict, key: str, what: str) -> str:
    value = _field(held, key, str, what)
    if not value.strip():
        raise DefinitionError(f"{what}: {key} is empty")
    return value


def _identifier(held: dict, what: str) -> int:
    value = _field(held, "canId", (int, str), what)
    if isinstance(value, int):
        return value
    try:
        return int(value, 0)
    except ValueError:
        raise DefinitionError(f"{what}: canId is {value!r}") from None


def _object(value, what: str) -> dict:
    if not isinstance(value, dict):
        raise DefinitionError(f"{what}: not an object")
    return value


def read_definitions(path: str) -> list[Message]:
    """The messages of a definition file (read on the driver), checked."""
    try:
        with open(path) as f:
            return parse_definitions(json.load(f))
    except json.JSONDecodeError as e:
        raise DefinitionError(f"{path}: {e}") from None


def parse_definitions(found: dict) -> list[Message]:
    """Messages of a definition document. Without ``isLittleEndian`` a signal has Motorola order; names and identifiers are unique."""
    out: list[Message] = []
    for k, held in enumerate(_field(_object(found, "the document"), "params", list, "the document")):
        p = _object(held, f"params[{k}]")
        can_id, name = _identifier(p, f"params[{k}]"), _text(p, "name", f"params[{k}]")
        extended = _field(p, "isExtendedFrame", bool, name, can_id > 0x7FF)
        if not 0 <= can_id <= (MAX_ID if extended else 0x7FF):
            raise DefinitionError(f"identifier {can_id:#x} is out of range")
        signals = tuple(_signal(_object(x, f"{name}.signals"), name) for x in _field(p, "signals", list, name))
        if len({s.name for s in signals}) < len(signals):
            raise DefinitionError(f"message {name!r} names a signal twice")
        out.append(Message(can_id, name, extended, signals))
    if len({(m.can_id, m.extended) for m in out}) < len(out):
        raise DefinitionError("an identifier is defined twice")
    if len({m.name for m in out}) < len(out):
        raise DefinitionError("two messages have one name")
    if len(out) > MOST_MESSAGES:
        raise DefinitionError(f"more than {MOST_MESSAGES} messages")
    return out


def _signal(s: dict, message: str) -> Signal:
    name = _text(s, "name", message)
    what = f"{message}.{name}"
    number = lambda key, default: float(_field(s, key, (int, float), what, default))
    return Signal(
        name, _field(s, "startBit", int, what), _field(s, "bitLength", int, what), _field(s, "isLittleEndian", bool, what, False), _field(s, "isSigned", bool, what, False),
        number("factor", 1), number("offset", 0), _field(s, "postfixMetric", str, what, ""),
    )


# --- frames ------------------------------------------------------------------------------------


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """``lines`` with ts, interface, can_id, is_extended, is_fd, fd_flags, data and ``problem`` (NULL for a good or blank line).

    Two forms: ``(ts) if ID#HEX`` (``ID##FHEX`` for FD) and ``(ts) if ID [n] B0 B1``, where a
    length of two digits means FD. More than three identifier digits make an extended frame.
    """
    text = F.col(line)
    # both forms in one layout: time, interface, identifier, separator or length, flags, payload
    compact = F.regexp_replace(text, COMPACT, CUT.join(["$1", "$2", "$3", "$4", "$5", "$6"]))
    bracket = F.regexp_replace(text, BRACKET, CUT.join(["$1", "$2", "$3", "$4", "", "$5"]))
    parts = F.split(F.when(text.rlike(COMPACT), compact).when(text.rlike(BRACKET), bracket), CUT)
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    frame = let(let(let(parts, _fields), lambda f: _with_problem(f, blank)), _with_data)
    got = lines.withColumn("__f", frame)
    names = ("ts", "interface", "can_id", "is_extended", "is_fd", "fd_flags", "data", "problem")
    return got.select(*lines.columns, *[F.col(f"__f.{n}").alias(n) for n in names])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once: a lambda variable holds it, so nested rules don't repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fields(p: Column) -> Column:
    part = lambda k: F.nullif(F.get(p, F.lit(k)), F.lit(""))
    is_compact = F.get(p, F.lit(3)).startswith("#")
    return F.struct(
        part(0).cast("double").alias("ts"), part(1).alias("interface"), F.conv(part(2), 16, 10).cast("long").alias("can_id"), (F.length(part(2)) > 3).alias("is_extended"),
        F.when(is_compact, F.length(part(3)) > 1).otherwise(F.length(part(3)) == 2).alias("is_fd"), F.conv(part(4), 16, 10).cast("int").alias("fd_flags"),
        F.regexp_replace(F.get(p, F.lit(5)), r"\s+", "").alias("digits"), F.when(~is_compact, part(3).cast("int")).alias("count"),
    )


def _with_problem(f: Column, blank: Column) -> Column:
    size = F.length(f["digits"]) / 2
    problem = (
        F.when(blank, F.lit(None).cast("string"))
        .when(f["can_id"].isNull(), F.lit("not a frame"))
        .when(F.length(f["digits"]) % 2 == 1, F.lit("odd number of hex digits"))
        .when(size > F.when(f["is_fd"], 64).otherwise(8), F.lit("payload too long"))
        .when(f["count"] != size, F.lit("length does not match the payload"))
        .when(f["can_id"] > F.when(f["is_extended"], MAX_ID).otherwise(0x7FF), F.lit("identifier out of range"))
    )
    return F.struct(f.alias("f"), problem.alias("problem"))


def _with_data(x: Column) -> Column:
    f = x["f"]
    same = [f[n].alias(n) for n in ("ts", "interface", "can_id", "is_extended", "is_fd", "fd_flags")]
    return F.struct(*same, F.when(x["problem"].isNull(), F.unhex(f["digits"])).alias("data"), x["problem"].alias("problem"))


def frames_of(lines: DataFrame, strict: bool = True) -> DataFrame:
    """The frames of parsed lines, blanks left out. ``strict``: a malformed line fails the job, with its number."""
    parsed = parse_lines(lines.where(F.trim("line") != ""))
    if strict:
        told = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), F.col("problem"))
        parsed = parsed.withColumn("can_id", F.when(F.col("problem").isNull(), F.col("can_id")).otherwise(F.raise_error(told).cast("long")))
    else:
        parsed = parsed.where("problem is null")
    return parsed.drop("problem", "line")


def _same_message(frames: DataFrame, known: DataFrame) -> Column:
    """The join condition. It is NULL-safe, though no key of ``known`` is NULL: else Spark would test the frames' keys for
    NULL before the join, and so parse each line once more for every such test."""
    return frames["can_id"].eqNullSafe(known["can_id"]) & frames["is_extended"].eqNullSafe(known["is_extended"])


def known_frames(frames: DataFrame, messages: list[Message]) -> DataFrame:
    """The frames that the definitions name."""
    known = message_table(frames.sparkSession, messages).select("can_id", "is_extended")
    return frames.join(F.broadcast(known), _same_message(frames, known), "left_semi")


def known_problems(parsed: DataFrame, messages: list[Message]) -> DataFrame:
    """run_id, line_no, problem of parsed lines that can't be decoded: malformed ones, and frames that the definitions name without a time or with too short a payload."""
    known = message_table(parsed.sparkSession, messages).select("can_id", "is_extended", "bytes_needed")
    joined = parsed.join(F.broadcast(known), _same_message(parsed, known), "left")
    named = F.col("bytes_needed").isNotNull()
    problem = F.coalesce(F.col("problem"), F.when(named & F.col("ts").isNull(), "a decoded frame needs a time"), F.when(named & (F.length("data") < F.col("bytes_needed")), "the payload is too short"))
    return joined.select("run_id", "line_no", problem.alias("problem")).where("problem IS NOT NULL")


_SHARE = "struct<word:int,shift:int,mask:bigint,place:int>"
_SIGNAL = f"struct<signal:string,column:string,unit:string,factor:double,offset:double,signed:boolean,bits:int,shares:array<{_SHARE}>>"
_WORD_BYTES = 8


def _parts(s: Signal) -> list[tuple[int, int, int, int]]:
    """(word, shift, mask, place) of each byte's part, the bytes of a word from its top."""
    return [(byte // _WORD_BYTES, 8 * (_WORD_BYTES - 1 - byte % _WORD_BYTES) + low, mask, place) for byte, low, mask, place in s.shares()]


def message_table(spark: SparkSession, messages: list[Message], names: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """can_id, is_extended, message, bytes_needed, signals: at most ``MOST_MESSAGES`` rows."""
    rows = []
    for m in messages:
        own = [(s.name, (names or {}).get((m.name, s.name), s.name), s.unit, float(s.factor), float(s.offset), s.signed, s.bit_length, _parts(s)) for s in m.signals]
        rows.append((m.can_id, m.extended, m.name, m.bytes_needed(), own))
    return spark.createDataFrame(rows, f"can_id bigint, is_extended boolean, message string, bytes_needed int, signals array<{_SIGNAL}>")


def _word(text: Column, k: Column | int) -> Column:
    """The ``k``-th 64 bits of a payload in hexadecimal, filled up with zeros, as a number with sign."""
    start = k * 16 + 1 if isinstance(k, Column) else F.lit(16 * k + 1)
    return F.conv(F.rpad(F.substring(text, start, F.lit(16)), 16, "0"), 16, -10).cast("bigint")


def _shift(name: str, value: Column, by: Column | int) -> Column:
    return F.call_function(name, value, by if isinstance(by, Column) else F.lit(by))


def signal_value(words: Column, signal: Column) -> Column:
    """A signal's value from the payload's words: each byte's part is masked and shifted into its place. Beyond 64 bits in doubles."""
    def part(x: Column) -> Column:
        return _shift("shiftright", F.get(words, x["word"]), x["shift"]).bitwiseAND(x["mask"])

    def number(raw: Column) -> Column:
        negative = signal["signed"] & (signal["bits"] < 64) & (raw >= _shift("shiftleft", F.lit(1).cast("bigint"), signal["bits"] - 1))
        wrapped = ~signal["signed"] & (raw < 0)
        turn = _shift("shiftleft", F.lit(1).cast("bigint"), signal["bits"])
        return F.when(negative, (raw - turn).cast("double")).when(wrapped, raw.cast("double") + F.lit(2.0**64)).otherwise(raw.cast("double"))

    def sum_of(value: Callable[[Column], Column]) -> Column:
        return F.aggregate(signal["shares"], F.lit(0.0), lambda total, x: total + value(x).cast("double") * F.pow(F.lit(2.0), x["place"]))

    exact = F.aggregate(signal["shares"], F.lit(0).cast("bigint"), lambda total, x: total.bitwiseOR(_shift("shiftleft", part(x), x["place"])), number)
    top = F.exists(signal["shares"], lambda x: (x["place"] + F.bit_count(x["mask"]) == signal["bits"]) & (part(x) * 2 > x["mask"]))
    wide = F.when(signal["signed"] & top, -1.0 - sum_of(lambda x: x["mask"] - part(x))).otherwise(sum_of(part))
    return F.when(signal["bits"] <= 64, exact).otherwise(wide) * signal["factor"] + signal["offset"]


def plain_value(s: Signal, words: list[Column]) -> Column:
    """The same for one known signal: shifts and masks alone."""
    parts = [(_shift("shiftright", words[word], shift).bitwiseAND(F.lit(mask)), mask, place) for word, shift, mask, place in _parts(s)]
    if s.bit_length > 64:
        raw = sum((x.cast("double") * F.lit(2.0**place) for x, _, place in parts), F.lit(0.0))
        if s.signed:  # a negative number by its complement, which keeps small ones exact
            head, mask, _ = max(parts, key=lambda part: part[2])
            raw = F.when(head * 2 > mask, -1.0 - sum(((F.lit(m) - x).cast("double") * F.lit(2.0**place) for x, m, place in parts), F.lit(0.0))).otherwise(raw)
    else:
        total = None
        for x, _, place in parts:
            moved = _shift("shiftleft", x.cast("bigint"), place) if place else x.cast("bigint")
            total = moved if total is None else total.bitwiseOR(moved)
        if s.signed and s.bit_length < 64:
            total = _shift("shiftright", _shift("shiftleft", total, 64 - s.bit_length), 64 - s.bit_length)
        raw = total.cast("double")
        raw = F.when(total < 0, raw + F.lit(2.0**64)).otherwise(raw) if not s.signed and s.bit_length == 64 else raw
    return raw * F.lit(float(s.factor)) + F.lit(float(s.offset))


def changed_frames(frames: DataFrame, run: str = "run_id", order: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """Frames whose payload or flags differ from the one before with the same interface and identifier."""
    w = Window.partitionBy(run, "interface", "can_id", "is_extended").orderBy(*order)
    now = F.struct("data", "is_fd", "fd_flags")
    fresh = (F.row_number().over(w) == 1) | ~now.eqNullSafe(F.lag(now).over(w))
    return frames.withColumn("__fresh", fresh).where("__fresh").drop("__fresh")


def last_times(frames: DataFrame, run: str = "run_id") -> DataFrame:
    """One row per run that holds its last time alone, so that what is resampled covers suppressed frames."""
    return frames.groupBy(run).agg(F.max("ts").alias("ts"))


# --- signals -----------------------------------------------------------------------------------


def _checked(frames: DataFrame, messages: list[Message], names: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """Known frames with message, signals and ``__hex``. A payload too short for its message fails the job."""
    table = message_table(frames.sparkSession, messages, names)
    known = frames.join(F.broadcast(table), _same_message(frames, table)).select(*[frames[c] for c in frames.columns], "message", "bytes_needed", "signals")
    told = F.concat(F.lit("payload too short for message "), F.col("message"))
    text = F.when(F.length("data") < F.col("bytes_needed"), F.raise_error(told).cast("string")).otherwise(F.hex("data"))
    return known.withColumn("__hex", text).drop("bytes_needed")


def _unrolled(messages: list[Message]) -> bool:
    return 0 < sum(len(m.signals) for m in messages) <= UNROLLED


def _with_words(rows: DataFrame, messages: list[Message]) -> tuple[DataFrame, list[Column]]:
    """``rows`` with a column for each word of the payload that the messages need."""
    n = -(-max(m.bytes_needed() for m in messages) // _WORD_BYTES)
    held = rows.withColumns({f"__w{k}": _word(F.col("__hex"), k) for k in range(n)})
    return held, [F.col(f"__w{k}") for k in range(n)]


def _all_words(rows: DataFrame) -> DataFrame:
    last = F.greatest(F.ceil(F.length("__hex") / 16).cast("int") - 1, F.lit(0))
    return rows.withColumn("__words", F.transform(F.sequence(F.lit(0), last), lambda k: _word(F.col("__hex"), k)))


def _is(m: Message) -> Column:
    return (F.col("can_id") == F.lit(m.can_id)) & (F.col("is_extended") == F.lit(m.extended))


def decode_long(frames: DataFrame, messages: list[Message]) -> DataFrame:
    """``frames`` with message, signal, value and unit: a row per signal."""
    rows = _checked(frames, messages)
    if _unrolled(messages):
        held, words = _with_words(rows.drop("signals"), messages)
        cases = [(_is(m), F.array(*[F.struct(F.lit(s.name).alias("signal"), plain_value(s, words).alias("value"), F.lit(s.unit).alias("unit")) for s in m.signals])) for m in messages if m.signals]
        found = F.when(*cases[0])
        for case in cases[1:]:
            found = found.when(*case)
        return held.withColumn("__s", F.explode(found)).select(*frames.columns, "message", "__s.signal", "__s.value", "__s.unit")
    rows = _all_words(rows).withColumn("__s", F.explode("signals"))
    return rows.select(*frames.columns, "message", F.col("__s.signal").alias("signal"), signal_value(F.col("__words"), F.col("__s")).alias("value"), F.col("__s.unit").alias("unit"))


def column_names(messages: list[Message], reserved: tuple[str, ...] = ()) -> dict[tuple[str, str], str]:
    """Wide column per (message, signal): the signal's name, with its message before it where that is not unique or reserved."""
    seen: dict[str, int] = {}
    for m in messages:
        for s in m.signals:
            seen[s.name] = seen.get(s.name, 0) + 1
    out = {(m.name, s.name): s.name if seen[s.name] == 1 and s.name not in reserved else f"{m.name}.{s.name}" for m in messages for s in m.signals}
    if len(set(out.values())) < sum(len(m.signals) for m in messages) or set(out.values()) & set(reserved):
        raise DefinitionError("column names collide")
    return out


def decode_wide(frames: DataFrame, messages: list[Message]) -> DataFrame:
    """``frames`` with a column per signal, filled where the frame carries it: no shuffle."""
    names = column_names(messages, tuple(frames.columns))
    rows = _checked(frames, messages, names)
    if _unrolled(messages):
        held, words = _with_words(rows, messages)
        return held.select(*frames.columns, *[F.when(_is(m), plain_value(s, words)).alias(names[m.name, s.name]) for m in messages for s in m.signals])
    values = F.map_from_arrays(F.transform("signals", lambda x: x["column"]), F.transform("signals", lambda x: signal_value(F.col("__words"), x)))
    held = _all_words(rows).withColumn("__v", values)
    return held.select(*frames.columns, *[F.try_element_at("__v", F.lit(n)).alias(n) for n in names.values()])


def long_table(decoded: DataFrame) -> DataFrame:
    """The columns of a long file, with the identifier in hexadecimal."""
    ident = F.concat(F.lit("0x"), F.hex("can_id"))
    return decoded.select(F.col("ts").alias("timestamp"), "interface", ident.alias("can_id"), "is_extended", "message", "signal", "value", "unit")


def message_counts(decoded: DataFrame) -> DataFrame:
    return decoded.groupBy("message").agg(F.count(F.lit(1)).alias("n"))
