"""Shredding: fields that have one scalar type throughout a segment lie in typed columns instead of the map.

Parquet prunes and filters such columns as it can't do with the values of a map.
A layout says which fields these are; it is closed if there are no others.  The
names of the columns differ even where those of fields differ in case only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fields import tag_of
from .values import LANE, STORED, Tag

LANES = "lanes"
TYPES = {Tag.BOOL: "boolean", Tag.I64: "bigint", Tag.U64: "decimal(20,0)", Tag.F64: "double", Tag.STRING: "string"}


@dataclass(frozen=True)
class Layout:
    lanes: tuple[tuple[str, int], ...] = ()  # (field, tag)
    closed: bool = False


def column_of(field: str, tag: int) -> str:
    return f"{LANE[Tag(tag)]}_" + re.sub(r"[^a-z0-9_]", lambda m: f"${ord(m[0]):x}$", field)


def of_schema(schema: T.StructType, id: str | None, most: int) -> Layout:
    """The layout of documents made of typed columns."""
    tags = [(f.name, tag_of(f.dataType)) for f in schema.fields if f.name != id]
    lanes = [(n, int(Tag.STRING if t is None else t)) for n, t in tags if t is None or t in TYPES]
    return Layout(tuple(lanes[:most]), len(tags) <= most and len(lanes) == len(tags))


def of_rows(fields: Iterable[dict[str, dict]], most: int) -> Layout:
    """The layout of stored values; of more fields than ``most`` the frequent ones."""
    counts, tags = Counter(), {}
    for values in fields:
        counts.update(values.keys())
        for name, v in values.items():
            tags.setdefault(name, set()).add(v["tag"])
    lanes = [(n, min(tags[n])) for n in sorted(tags, key=lambda n: (-counts[n], n)) if len(tags[n]) == 1 and min(tags[n]) in TYPES]
    return Layout(tuple(lanes[:most]), len(lanes) == len(tags) <= most)


def joint(layouts: list[Layout]) -> Layout:
    """The layout that several have together: fields which none of them has with another type, or may have."""
    tags: dict[str, set[int]] = {}
    for x in layouts:
        for name, tag in x.lanes:
            tags.setdefault(name, set()).add(tag)
    open_ = [{n for n, _ in x.lanes} for x in layouts if not x.closed]
    lanes = tuple((n, min(t)) for n, t in tags.items() if len(t) == 1 and all(n in names for names in open_))
    return Layout(lanes, not open_ and len(lanes) == len(tags))


def schema_of(layouts: Iterable[Layout]) -> str | None:
    """The struct of all lanes of several layouts."""
    lanes = dict.fromkeys(lane for x in layouts for lane in x.lanes)
    return "struct<" + ",".join(f"`{column_of(n, t)}`:{TYPES[Tag(t)]}" for n, t in lanes) + ">" if lanes else None


def shred(df: DataFrame, layout: Layout) -> DataFrame:
    """Moves the layout's fields out of the map."""
    if not layout.lanes:
        return df
    x = F.col("fields")
    lanes = F.struct(*(x[n][LANE[Tag(t)]].alias(column_of(n, t)) for n, t in layout.lanes))
    rest = F.map_filter(x, lambda k, _: ~k.isin([n for n, _ in layout.lanes]))
    return df.withColumns({LANES: lanes, "fields": F.create_map().cast(f"map<string,{STORED}>") if layout.closed else rest})


def stored(tag: int, value: Column) -> Column:
    """A value as the map holds it."""
    names = ("tag", "b", "i", "u", "d", "s", "y", "c")
    lanes = {"tag": F.lit(int(tag)), LANE[Tag(tag)]: value}
    return F.struct(*(lanes.get(n, F.lit(None)).alias(n) for n in names)).cast(STORED)


def entries(values: list[tuple[str, int, Column]]) -> Column:
    """The map of (field, tag, value), without those whose value is null."""
    if not values:
        return F.create_map().cast(f"map<string,{STORED}>")
    made = [F.when(c.isNotNull(), F.struct(F.lit(n).alias("key"), stored(t, c).alias("value"))) for n, t, c in values]
    return F.map_from_entries(F.filter(F.array(*made), lambda x: x.isNotNull()))


def restored(layouts: Iterable[Layout]) -> Column:
    """The whole map of rows that were shredded by any of the layouts."""
    lanes = dict.fromkeys(lane for x in layouts for lane in x.lanes)
    if not lanes:
        return F.col("fields")
    return F.map_concat("fields", entries([(n, t, F.col(LANES)[column_of(n, t)]) for n, t in lanes]))
