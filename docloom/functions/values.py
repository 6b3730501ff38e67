"""Typed values of documents.

Ten types, told apart by a tag; equality is strict, so the integer 5, the
unsigned 5 and the float 5.0 are three different values.  Plain Python values
are lifted: bool, int (signed 64-bit), float, str, bytes, uuid.UUID, None, lists
and dicts.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from dataclasses import dataclass
from decimal import Decimal
from enum import IntEnum
from typing import Any

from ..errors import DocumentError, UnknownTag


class Tag(IntEnum):
    """Type tags; their order is also the order of values of different types."""

    NULL = 0
    BOOL = 1
    I64 = 2
    U64 = 3
    F64 = 4
    STRING = 5
    BYTES = 6
    UUID = 7
    ARRAY = 8
    DOCUMENT = 9


#: Types with an order; the others can only be equal.
ORDERED = frozenset({Tag.BOOL, Tag.I64, Tag.U64, Tag.F64, Tag.STRING, Tag.BYTES})


@dataclass(frozen=True)
class Value:
    tag: Tag
    raw: Any

    def __post_init__(self):
        if self.tag == Tag.I64 and not -(2**63) <= self.raw < 2**63 or self.tag == Tag.U64 and not 0 <= self.raw < 2**64:
            raise DocumentError(f"{self.raw} is out of range for {self.tag.name}")

    @property
    def is_nan(self) -> bool:
        return self.tag == Tag.F64 and math.isnan(self.raw)

    def canonical(self) -> str:
        """Text that is equal exactly for equal values; fields of documents sorted."""
        if self.tag in (Tag.ARRAY, Tag.DOCUMENT):
            parts = [v.canonical() for v in self.raw] if self.tag == Tag.ARRAY else {k: v.canonical() for k, v in sorted(self.raw)}
            return _dump([int(self.tag), parts])
        raw = self.raw.hex() if isinstance(self.raw, bytes) else _float_text(self.raw + 0.0) if self.tag == Tag.F64 else self.raw
        return _dump([int(self.tag), raw])

    def python(self) -> Any:
        if self.tag == Tag.ARRAY:
            return [v.python() for v in self.raw]
        if self.tag == Tag.DOCUMENT:
            return {k: v.python() for k, v in self.raw}
        return uuid.UUID(bytes=self.raw) if self.tag == Tag.UUID else self.raw


def _dump(x: Any) -> str:
    """JSON as Spark writes it, so that both give equal values equal texts: escapes have capital digits."""
    text = json.dumps(x, separators=(",", ":"), ensure_ascii=False)
    return re.sub(r"\\(u[0-9a-f]{4}|.)", lambda m: m[0][:2] + m[0][2:].upper(), text)


def _float_text(x: float) -> str:
    """A double as Spark casts it to a string: plain from 0.001 to 10,000,000, else with an exponent."""
    if not math.isfinite(x):
        return "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return format(Decimal(repr(x)), "f")
    digits = "".join(map(str, Decimal(repr(x)).as_tuple().digits)).rstrip("0")
    return f"{'-' if x < 0 else ''}{digits[0]}.{digits[1:] or '0'}E{Decimal(repr(x)).adjusted()}"


def u64(n: int) -> Value:
    return Value(Tag.U64, int(n))


def lift(x: Any) -> Value:
    """The value of a plain Python object."""
    if isinstance(x, Value):
        return x
    if x is None:
        return Value(Tag.NULL, None)
    for kind, tag in ((bool, Tag.BOOL), (int, Tag.I64), (float, Tag.F64), (str, Tag.STRING), (bytes, Tag.BYTES)):
        if isinstance(x, kind):
            return Value(tag, x)
    if isinstance(x, uuid.UUID):
        return Value(Tag.UUID, x.bytes)
    if isinstance(x, (list, tuple)):
        return Value(Tag.ARRAY, tuple(lift(v) for v in x))
    if isinstance(x, dict):
        return Value(Tag.DOCUMENT, tuple(sorted((str(k), lift(v)) for k, v in x.items())))
    raise DocumentError(f"no document value for {type(x).__name__}")


#: How one value is stored: its tag and, for its type, one of the lanes.
STORED = "struct<tag:tinyint,b:boolean,i:bigint,u:decimal(20,0),d:double,s:string,y:binary,c:string>"
LANE = {
    Tag.BOOL: "b",
    Tag.I64: "i",
    Tag.U64: "u",
    Tag.F64: "d",
    Tag.STRING: "s",
    Tag.BYTES: "y",
    Tag.UUID: "y",
    Tag.ARRAY: "c",
    Tag.DOCUMENT: "c",
}


def encode(value: Any) -> dict:
    """The stored form of a value."""
    v = lift(value)
    row = dict.fromkeys(("b", "i", "u", "d", "s", "y", "c")) | {"tag": int(v.tag)}
    if v.tag in (Tag.ARRAY, Tag.DOCUMENT):
        row["c"] = v.canonical()
    elif v.tag != Tag.NULL:
        row[LANE[v.tag]] = Decimal(v.raw) if v.tag == Tag.U64 else v.raw
    return row


def _from_canonical(text: str) -> Value:
    tag, raw = json.loads(text)
    tag = Tag(tag)
    if tag == Tag.ARRAY:
        return Value(tag, tuple(_from_canonical(x) for x in raw))
    if tag == Tag.DOCUMENT:
        return Value(tag, tuple(sorted((k, _from_canonical(x)) for k, x in raw.items())))
    if tag in (Tag.BYTES, Tag.UUID):
        return Value(tag, bytes.fromhex(raw))
    return Value(tag, float(raw) if tag == Tag.F64 else raw)


def decode(row: Any) -> Value:
    """The value of a stored form (a Row or dict)."""
    get = row.__getitem__
    try:
        tag = Tag(get("tag"))
    except ValueError as e:
        raise UnknownTag(str(get("tag"))) from e
    if tag == Tag.NULL:
        return Value(tag, None)
    if tag in (Tag.ARRAY, Tag.DOCUMENT):
        return _from_canonical(get("c"))
    raw = get(LANE[tag])
    return Value(tag, int(raw) if tag == Tag.U64 else bytes(raw) if tag in (Tag.BYTES, Tag.UUID) else raw)
