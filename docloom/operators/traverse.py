"""Traversal: an equi-semi-join of one collection with itself, repeated.

Each hop takes the values of ``from_field`` in the documents found last and
finds all documents whose ``to_field`` holds one of them, unless an earlier hop
found them.  The start documents themselves are no result, but a hop may lead
back to them.  Values are joined by strict equality: types must be the same,
null matches null, NaN nothing, and missing fields take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fields import ID, TypedFields
from ..plans import query as Q
from ..plans.compiler import Fields, compile_filter
from ..sources.files import Scratch

HOP = "_hop"


def traverse(df: DataFrame, q: Q.Traverse, fields: Fields) -> DataFrame:
    """The documents found, with the hop (from 1) that found them, in order of hop and _id.

    Frontiers are written between hops, which cuts the lineage and lets Spark
    choose each hop's join by the frontier's real size.
    """
    empty = df.withColumn(HOP, F.lit(1)).limit(0)
    source, target = fields.join_key(q.from_field), fields.join_key(q.to_field)
    if q.depth <= 0 or source is None or target is None:
        return empty
    if isinstance(fields, TypedFields) and fields.join_tag(q.from_field) != fields.join_tag(q.to_field):
        return empty
    scratch = Scratch(df.sparkSession, "traverse")
    id_ = fields.columns[ID] if isinstance(fields, TypedFields) else ID
    start = df if q.start is None else df.where(compile_filter(q.start, fields))
    keys, found, seen = start.select(source.alias("_key")), [], None
    for hop in range(1, q.depth + 1):
        keys = keys.where("_key is not null").distinct()
        reached = df.withColumn("_to", target).join(keys, F.col("_to") == F.col("_key"), "left_semi").drop("_to")
        if seen is not None:
            reached = reached.join(seen, id_, "left_anti")
        reached = scratch.save(reached.withColumn(HOP, F.lit(hop)))
        if reached.isEmpty():
            break
        found.append(reached)
        seen = reached.select(id_) if seen is None else seen.union(reached.select(id_))
        keys = reached.select(source.alias("_key"))
    if not found:
        return empty
    return reduce(DataFrame.unionByName, found).orderBy(HOP, id_)
