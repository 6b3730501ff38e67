"""Queries as data: Get, Scan and Traverse, and the filters they are built from."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, Union

from ..functions.values import Value, lift


@dataclass(frozen=True)
class Eq:
    field: str
    value: Any


@dataclass(frozen=True)
class Gt:
    field: str
    value: Any


@dataclass(frozen=True)
class Lt:
    field: str
    value: Any


@dataclass(frozen=True)
class Range:
    """low <= field < high."""

    field: str
    low: Any
    high: Any


@dataclass(frozen=True)
class Exists:
    """The field is there; a null value counts."""

    field: str


@dataclass(frozen=True)
class And:
    parts: tuple[Filter, ...] = ()

    def __init__(self, *parts: Filter):
        object.__setattr__(self, "parts", tuple(parts))


@dataclass(frozen=True)
class Or:
    parts: tuple[Filter, ...] = ()

    def __init__(self, *parts: Filter):
        object.__setattr__(self, "parts", tuple(parts))


@dataclass(frozen=True)
class Not:
    part: Filter


Filter = Union[Eq, Gt, Lt, Range, Exists, And, Or, Not]
LEAVES = (Eq, Gt, Lt, Range, Exists)


@dataclass(frozen=True)
class SortField:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class Get:
    id: Any


@dataclass(frozen=True)
class Scan:
    filter: Filter | None = None
    sort: tuple[SortField, ...] = ()
    project: tuple[str, ...] | None = None
    limit: int | None = None


@dataclass(frozen=True)
class Traverse:
    """From the documents of ``start`` along ``from_field`` = ``to_field``, up to ``depth`` times."""

    start: Filter | None
    from_field: str
    to_field: str
    depth: int = field(default=1)


Query = Union[Get, Scan, Traverse]


def leaves(f: Filter | None) -> Iterator[Eq | Gt | Lt | Range | Exists]:
    if f is None:
        return
    if isinstance(f, LEAVES):
        yield f
    else:
        for part in (f.part,) if isinstance(f, Not) else f.parts:
            yield from leaves(part)


def filter_fields(f: Filter | None) -> tuple[str, ...]:
    """Fields of a filter, sorted, each once."""
    return tuple(sorted({leaf.field for leaf in leaves(f)}))


def literals(f: Eq | Gt | Lt | Range) -> tuple[Value, ...]:
    return (lift(f.low), lift(f.high)) if isinstance(f, Range) else (lift(f.value),)
