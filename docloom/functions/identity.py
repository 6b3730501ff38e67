"""Document ids: 16 bytes that start with the time, written as 32 hex digits.

Lower-case hex of equal length sorts as the bytes do, in Spark and in Parquet
statistics, and stays readable.
"""

from __future__ import annotations

import os
import threading
import time

from ..errors import DocumentError

NIL = "0" * 32
LATEST = "f" * 32

_lock = threading.Lock()
_last = 0


def new_id(now_ms: int | None = None) -> str:
    """A version-7 UUID; ids of one process rise strictly."""
    global _last
    with _lock:
        stamp = (int(time.time() * 1000) if now_ms is None else now_ms) << 12
        _last = stamp = max(stamp, _last + 1)
    high = (stamp >> 12) << 16 | 0x7000 | stamp & 0xFFF
    low = int.from_bytes(os.urandom(8)) & (1 << 62) - 1 | 1 << 63
    return f"{high << 64 | low:032x}"


def from_bytes(raw: bytes) -> str:
    if len(raw) != 16:
        raise DocumentError(f"an id has 16 bytes, not {len(raw)}")
    return raw.hex()


def as_bytes(id_: str) -> bytes:
    return bytes.fromhex(id_)


def is_nil(id_: str) -> bool:
    return id_ == NIL
