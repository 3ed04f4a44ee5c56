"""ROS 2 messages: a definition text gives a reader of CDR bytes; numbers come out as named leaves."""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Iterator

# Primitive types and their struct codes.
PRIMITIVES = {"bool": "?", "byte": "B", "char": "B", "int8": "b", "uint8": "B", "int16": "h", "uint16": "H", "int32": "i", "uint32": "I", "int64": "q", "uint64": "Q", "float32": "f", "float64": "d"}
DEPTH, LONGEST_ARRAY = 6, 1000
LEFT_OUT = {"covariance", "timestamp", "stamp"}
_FIELD = re.compile(r"^([\w/]+)(<=\d+)?(\[(<=)?(\d*)\])?\s+(\w+)\s*(=.*|[^=\s].*)?$")

Field = tuple[str, str, str | None, int | None]  # name, type, "fixed" / "list" / None, length


def definitions(root: str, text: str) -> dict[str, list[Field]]:
    """Fields by type of a definition and the ones that it brings along."""
    out: dict[str, list[Field]] = {}
    for k, part in enumerate(re.split(r"^=+\s*$", text, flags=re.M)):
        lines, name = part.strip().splitlines(), root
        if k and lines and lines[0].startswith("MSG:"):
            name, lines = lines[0][4:].strip(), lines[1:]
        fields: list[Field] = []
        for line in lines:
            line = line.split("#")[0].strip()
            if not (m := _FIELD.match(line)):
                continue
            kind, _, array, bounded, length, field, rest = m.groups()
            if rest and rest.startswith("="):
                continue  # a constant
            shape = None if not array else "list" if bounded or not length else "fixed"
            fields.append((field, kind, shape, int(length) if shape == "fixed" else None))
        out[_short(name)] = fields
    return out


def _short(name: str) -> str:
    return name.replace("/msg/", "/")


class Cdr:
    """A cursor over CDR bytes: values are aligned from behind the four bytes of the header."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.order = raw, 4, "<" if raw[1] & 1 else ">"

    def number(self, code: str):
        size = struct.calcsize(code)
        self.at += -(self.at - 4) % size
        (value,) = struct.unpack_from(self.order + code, self.raw, self.at)
        self.at += size
        return value

    def text(self) -> str:
        n = self.number("I")
        value = self.raw[self.at : self.at + max(n - 1, 0)].decode("utf-8", "replace")
        self.at += n
        return value


def read_value(cdr: Cdr, kind: str, types: dict[str, list[Field]], package: str):
    if kind in PRIMITIVES:
        return cdr.number(PRIMITIVES[kind])
    if kind.startswith(("string", "wstring")):
        return cdr.text()
    if kind in ("time", "duration", "builtin_interfaces/Time", "builtin_interfaces/Duration") and _short(kind) not in types:
        return {"sec": cdr.number("i"), "nanosec": cdr.number("I")}
    name = _short(kind if "/" in kind else f"{package}/{kind}")
    name = name if name in types else next(t for t in types if t.endswith(f"/{kind}"))
    out = {}
    for field, own, shape, length in types[name]:
        if shape is None:
            out[field] = read_value(cdr, own, types, name.split("/")[0])
        else:
            n = length if shape == "fixed" else cdr.number("I")
            out[field] = [read_value(cdr, own, types, name.split("/")[0]) for _ in range(n)]
    if not types[name]:
        cdr.number("B")  # an empty message holds one byte
    return out


def decode(raw: bytes, root: str, types: dict[str, list[Field]]):
    return read_value(Cdr(raw), root, types, root.split("/")[0])


def euler(q: dict) -> dict[str, float]:
    x, y, z, w = (float(q[k]) for k in "xyzw")
    n = math.sqrt(x * x + y * y + z * z + w * w)
    if not n:
        raise ValueError("a quaternion of length 0")
    x, y, z, w = x / n, y / n, z / n, w / n
    return {
        "roll": math.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), "pitch": math.asin(max(-1.0, min(1.0, 2 * (w * y - z * x)))),
        "yaw": math.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)),
    }


def leaves(value, path: str, depth: int = 0) -> Iterator[tuple[str, float]]:
    """(path, number) of all numbers; texts, long arrays and what lies too deep are left out."""
    if isinstance(value, (bool, int, float)):
        yield path, float(value)
    elif depth >= DEPTH:
        return
    elif isinstance(value, list):
        if len(value) <= LONGEST_ARRAY:
            for k, x in enumerate(value):
                yield from leaves(x, f"{path}/{k}", depth + 1)
    elif isinstance(value, dict):
        if value.keys() >= set("xyzw"):
            for k, x in euler(value).items():
                yield f"{path}/{k}", x
        for k, x in value.items():
            if not k.startswith("_") and k not in LEFT_OUT:
                yield from leaves(x, f"{path}/{k}", depth + 1)
