"""From query data to DataFrames.

Predicates have two values: a test of a missing field is false, and its negation
true.  Spark's WHERE reads unknown as false already, so tests that stand under
AND and OR only are emitted as they are and reach the Parquet scan; those under
a NOT are closed with ``coalesce(test, false)``.  Tests that can't hold for their
types are false at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fields import ID, TaggedFields, TypedFields
from . import query as Q

Fields = TypedFields | TaggedFields


def compile_filter(f: Q.Filter, fields: Fields, under_not: bool = False) -> Column:
    if isinstance(f, Q.And):
        return reduce(lambda a, b: a & b, (compile_filter(p, fields, under_not) for p in f.parts), F.lit(True))
    if isinstance(f, Q.Or):
        return reduce(lambda a, b: a | b, (compile_filter(p, fields, under_not) for p in f.parts), F.lit(False))
    if isinstance(f, Q.Not):
        return ~compile_filter(f.part, fields, True)
    if isinstance(f, Q.Exists):
        return fields.present(f.field)
    if isinstance(f, Q.Range):
        low, high = Q.literals(f)
        sides = [fields.compare(f.field, "ge", low), fields.compare(f.field, "lt", high)]
        test = None if None in [s if s is None else 0 for s in sides] else sides[0] & sides[1]
    else:
        op = {Q.Eq: "eq", Q.Gt: "gt", Q.Lt: "lt"}[type(f)]
        test = fields.compare(f.field, op, Q.literals(f)[0])
    if test is None:
        return F.lit(False)
    return F.coalesce(test, F.lit(False)) if under_not else test


def sort_columns(sort: tuple[Q.SortField, ...], fields: Fields) -> list[Column]:
    """Missing fields come last, first if descending; ties by _id, rising in both directions."""
    keys = [fields.sort_key(s.field).desc_nulls_first() if s.descending else fields.sort_key(s.field).asc_nulls_last() for s in sort]
    return [*keys, fields.sort_key(ID).asc()]


def scan(df: DataFrame, q: Q.Scan, fields: Fields) -> DataFrame:
    """Filter, sort, limit, then project.  Without a sort, a limit takes the smallest _ids."""
    if q.filter is not None:
        df = df.where(compile_filter(q.filter, fields))
    if q.sort or q.limit is not None:
        df = df.orderBy(*sort_columns(q.sort, fields))
    if q.limit is not None:
        df = df.limit(q.limit)
    return fields.project(df, q.project) if q.project is not None else df
