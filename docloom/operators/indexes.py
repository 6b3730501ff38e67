"""Sorted side-tables that queries build for themselves.

An index holds whole documents, range-partitioned and sorted by the values of
its fields, so a filter on them prunes files and row groups and needs no look-up,
and an ascending scan with a limit reads the first files only.  It covers a set of segments; documents written later (the tail) are
resolved against it when it is read, so it is never stale.  A partial index
keeps its predicate and serves only queries with the same one.
"""

from __future__ import annotations

import math
import time
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import DELETED, ID, VERSION, TaggedFields
from ..functions.values import LANE, Tag, decode, encode, lift
from ..plans import query as Q
from .versions import latest

#: Compactions without use, and hours without use, after which an index is dropped.
UNUSED_COMPACTIONS, UNUSED_HOURS = 10, 720.0


def dump_filter(f: Q.Filter | None) -> dict | None:
    if f is None:
        return None
    if isinstance(f, (Q.And, Q.Or)):
        return {"op": type(f).__name__, "parts": [dump_filter(p) for p in f.parts]}
    if isinstance(f, Q.Not):
        return {"op": "Not", "part": dump_filter(f.part)}
    values = {} if isinstance(f, Q.Exists) else {"values": [lift(v).canonical() for v in Q.literals(f)]}
    return {"op": type(f).__name__, "field": f.field} | values


def load_filter(x: dict | None) -> Q.Filter | None:
    if x is None:
        return None
    kind = getattr(Q, x["op"])
    if "parts" in x:
        return kind(*(load_filter(p) for p in x["parts"]))
    if "part" in x:
        return kind(load_filter(x["part"]))
    from ..functions.values import _from_canonical

    return kind(x["field"], *(_from_canonical(v) for v in x.get("values", [])))


@dataclass
class Index:
    name: str
    fields: list[str]
    predicate: dict | None
    covers: list[str]
    rows: int = 0
    unused_compactions: int = 0
    last_used: float = field(default_factory=time.time)
    files: list[list] = field(default_factory=list)  # [name, rows], in the order of keys

    def first_files(self, rows: int) -> list[str]:
        """The files that hold the first so many rows."""
        out, left = [], rows
        for name, n in self.files:
            if left <= 0 and out:
                break
            out.append(name)
            left -= n
        return out

    def to_dict(self) -> dict:
        return asdict(self)

    def serves_sort(self, fields: list[str], f: Q.Filter | None) -> bool:
        return self.fields == fields and (self.predicate is None or self.predicate == dump_filter(f))

    def serves_filter(self, f: Q.Filter) -> bool:
        return self.fields == [f.field] and (self.predicate is None or self.predicate == dump_filter(f))

    def used(self, now: float) -> None:
        self.unused_compactions, self.last_used = 0, now

    def to_drop(self, now: float) -> bool:
        return self.unused_compactions >= UNUSED_COMPACTIONS and now - self.last_used >= UNUSED_HOURS * 3600


def key_column(i: int) -> str:
    return f"_key{i}"


def build(docs: DataFrame, fields: list[str], partitions: int) -> DataFrame:
    """The rows of an index over live documents."""
    access = TaggedFields()
    out = docs.withColumns({key_column(i): access.sort_key(f) for i, f in enumerate(fields)})
    keys = [key_column(i) for i in range(len(fields))]
    order = [*(F.col(k).asc_nulls_last() for k in keys), F.col(ID).asc()]  # that of an ascending scan
    return out.repartitionByRange(partitions, *order).sortWithinPartitions(*order)


def prune(index: DataFrame, f: Q.Filter) -> DataFrame:
    """The index rows whose first key can satisfy a leaf; nested predicates reach the Parquet scan."""
    values = Q.literals(f)
    tag = values[0].tag
    if any(v.tag != tag or v.is_nan for v in values) or tag not in LANE or tag in (Tag.ARRAY, Tag.DOCUMENT):
        return index
    key = F.col(key_column(0))
    lane, stored = key[LANE[tag]], [encode(v)[LANE[tag]] for v in values]
    test: Column = key["tag"] == int(tag)
    if isinstance(f, Q.Range):
        test = test & (lane >= F.lit(stored[0])) & (lane < F.lit(stored[1]))
    else:
        test = test & {Q.Eq: lane == F.lit(stored[0]), Q.Gt: lane > F.lit(stored[0]), Q.Lt: lane < F.lit(stored[0])}[type(f)]
    return index.where(test)


def with_tail(index: DataFrame, tail: DataFrame) -> DataFrame:
    """Index rows as of now: documents with versions in the tail are taken from there."""
    columns = [ID, VERSION, DELETED, "fields"]
    touched = tail.select(ID).distinct()
    return index.select(*columns).join(touched, ID, "left_anti").unionByName(latest(tail).select(*columns))


def rebuild_pays(pending: int, entries: int) -> bool:
    """Whether so many pending documents make building anew cheaper than merging them."""
    return entries == 0 or pending > 0.5 * entries * math.log(entries) if entries != 1 else pending > 0


def widen_pays(pending: int, entries: int) -> bool:
    """Whether a partial index that is built anew should become a full one."""
    return entries == 0 or pending / entries >= 0.5


def merged_predicate(indexes: list[Index]) -> dict | None:
    """Of several partial indexes on the same fields: any of their predicates; full if one is."""
    predicates = [i.predicate for i in indexes]
    if None in predicates:
        return None
    return dump_filter(Q.Or(*(load_filter(p) for p in predicates)))


__all__ = ["Index", "build", "prune", "with_tail", "rebuild_pays", "widen_pays", "merged_predicate", "dump_filter", "load_filter", "decode"]
