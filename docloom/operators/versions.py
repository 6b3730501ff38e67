"""Version resolution: of each document the latest version that is visible, unless it is a tombstone."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fields import DELETED, ID, VERSION


def visible(df: DataFrame, bound: object | None = None, id: str = ID, version: str | list[str] = VERSION) -> DataFrame:
    """The newest version of each id at or before ``bound``, tombstones included.

    Spark keeps the newest of each id within a task before it shuffles
    (WindowGroupLimit), so an id with many versions moves one row per task.
    """
    order = [version] if isinstance(version, str) else version
    if bound is not None:
        df = df.where(F.col(order[0]) <= F.lit(bound))
    newest = Window.partitionBy(id).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def latest(df: DataFrame, bound: object | None = None, id: str = ID, version: str | list[str] = VERSION, deleted: Column | None = None) -> DataFrame:
    """The live documents: the newest visible versions without the deleted ones."""
    gone = F.col(DELETED) if deleted is None else deleted
    return visible(df, bound, id, version).where(~F.coalesce(gone, F.lit(False)))


def retain(df: DataFrame, bounds: list, id: str = ID, version: str | list[str] = VERSION) -> DataFrame:
    """The versions that some reader may still need: the newest of all, and the newest at or before each bound.

    These are the newest of each stretch of versions between two bounds, so that
    an id moves one row per task and stretch, and a hot id is pruned before it
    is shuffled.
    """
    order = [version] if isinstance(version, str) else version
    passed = reduce(add, (F.when(F.col(order[0]) > F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0))
    newest = Window.partitionBy(id, "_stretch").orderBy(*(F.col(c).desc() for c in order))
    ranked = df.withColumn("_stretch", passed).withColumn("_rank", F.row_number().over(newest))
    return ranked.where("_rank = 1").drop("_rank", "_stretch")
