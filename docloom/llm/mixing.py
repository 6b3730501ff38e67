"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every token of a source is an atom of weight 1.  Among all reweightings whose
tokens by source meet the targets, entropy balancing takes the one of least
relative entropy; it is an exponential tilt, rate = exp(lambda of the source),
whose multipliers minimise the convex dual

    sum over sources (size * exp(lambda) - target * lambda).

The dual's Hessian is diagonal, and source sizes are all that it needs of the
documents.  So one distributed aggregation combines each partition's tokens by
source, and the Newton iterations then run for all sources at once, as a fold
over each source's row on whichever executor holds it.

Targets need the level up to which sources are filled, which Newton steps on a
concave piecewise linear function find, each an aggregation over the sources.

Rates become whole copies.  Each document of a source gets floor(rate) copies;
the tokens still missing come from one more copy of the documents whose hash (of
id, source and text) lies under a threshold.  The threshold is found exactly by
three passes of a 4096-bin histogram of the hash, each inside the crossing bin
of the last, so no task ever sorts or holds a source.  The few tokens short of
the crossing document are filled by a greedy choice among a bounded number of
documents, the largest of each size class.

Rows that are alike in id, source and text are numbered, and their hash holds
their number, so that each of them is drawn by itself.  Numbers are counted task
by task from sums by task, so a row that stands there a million times is no
group of any task; as such rows are alike, it doesn't matter which has which.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import ranked
from .shared import Scratch

#: No target is over so many times its source's size, nor any document's copies.
MOST = 3
NEWTON_STEPS = 64
_BINS = 12  # bits of a histogram's bin
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(scratch: Scratch, sizes: DataFrame, cycle: int = 3, most: int = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size), a row per source.

    Sources by code point, null last, weigh 1 .. ``cycle`` in turn and share all
    tokens; where a share is over ``most`` times the source, the source gets
    that much and the excess is shared anew by weight.  So a source's target is
    min(most * size, level * weight), with the level at which targets sum to all
    tokens; from below, Newton steps reach it exactly once no further source is
    limited.
    """
    order = [F.col("source").asc_nulls_last()]
    weighed = ranked(sizes, order).select("source", "source_size", (F.pmod(F.col("place") - 1, F.lit(cycle)) + 1).alias("weight"))
    weighed = scratch.save(weighed)
    limit = most * F.col("source_size")
    total, weights = (x or 0 for x in weighed.agg(F.sum("source_size"), F.sum("weight")).first())
    level, limited = total / max(1, weights), 0
    while True:
        r = weighed.where(limit / F.col("weight") <= level).agg(F.count("*").alias("n"), F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
        if r["n"] == limited or r["weight"] == weights:
            break
        level, limited = (total - most * r["size"]) / (weights - r["weight"]), r["n"]
    return weighed.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), limit.cast("double")).alias("target"))


def _newton(size: Column, target: Column) -> Column:
    """The multiplier that minimises size * exp(x) - target * x, both positive."""
    step = lambda x, _: x - F.least(F.lit(1.0), 1 - target / size * F.exp(-x))
    return F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(0.0), step)


def _rows(scratch: Scratch, docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, source, size, u, seq) and ``more`` for each row; u is its hash in [0, 2 ** 36), read in three digits of 12 bits."""
    id_, source, text = F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    key = F.xxhash64(blank(id_), blank(source), blank(text), F.lit(42))
    rows = docs.select(id_.alias("doc_id"), source.alias("source"), word_count(text).alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("seq"), *more)
    rows = scratch.save(rows)
    again = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    task = F.shiftright("seq", 33).alias("task")  # of monotonically_increasing_id
    alike = scratch.save(rows.join(again, "key").select("key", task, "seq"))
    if alike.isEmpty():
        unit = F.col("key")
    else:
        upto = Window.partitionBy("key").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        before = alike.groupBy("key", "task").agg(F.count("*").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(upto), F.lit(0)))
        within = alike.withColumn("n", F.row_number().over(Window.partitionBy("key", "task").orderBy("seq")))
        numbers = scratch.save(within.join(before, ["key", "task"]).select("seq", (F.col("n") + F.col("before")).alias("number")))
        rows = rows.join(numbers, "seq", "left")
        unit = F.when(F.col("number") > 1, F.xxhash64("key", "number")).otherwise(F.col("key"))
    return rows.withColumn("u", F.shiftrightunsigned(unit, 64 - 3 * _BINS))


def _plan(scratch: Scratch, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row per source (rate, copies, flip, cut), and the single documents chosen beside the threshold.

    Where over half of a source's tokens need one more copy, those that don't
    are chosen instead (``flip``), so that small documents to choose from remain.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(scratch, sizes)
    rate = F.when((F.col("source_size") > 0) & (F.col("target") > 0), F.exp(_newton(F.col("source_size").cast("double"), F.col("target")))).otherwise(0.0)
    plan = plan.withColumn("rate", F.least(F.lit(float(MOST)), rate))
    # a rate within rounding of a whole number is that number
    whole = F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-9, F.round("rate")).otherwise(F.floor("rate"))
    plan = plan.withColumn("copies", whole.cast("long"))
    missing = F.greatest(F.lit(0), F.round(F.col("rate") * F.col("source_size")).cast("long") - F.col("copies") * F.col("source_size"))
    plan = plan.withColumn("missing", missing).withColumn("flip", 2 * F.col("missing") > F.col("source_size"))
    plan = plan.withColumn("goal", F.when(F.col("flip"), F.col("source_size") - F.col("missing")).otherwise(F.col("missing")))
    plan = scratch.save(plan)
    cut = _thresholds(scratch, rows, plan)
    plan = scratch.save(plan.join(cut, plan["source"].eqNullSafe(cut["name"])).drop("name"))
    return plan, scratch.save(_fill(rows, plan))


def _decide(rows: DataFrame, plan: DataFrame, fill: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source's plan and the number of copies, n."""
    plan = plan.withColumnRenamed("source", "name")
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("name"))).join(fill, "seq", "left")
    chosen = (F.col("u") < F.col("cut")) | F.col("filled").isNotNull()
    extra = F.when(chosen != F.col("flip"), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.least(F.lit(MOST), F.col("copies") + extra)).otherwise(0)
    return out.withColumn("n", copies.cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, source) for each row of ``docs`` (doc_id, text, source).

    ``size`` is the number of words (a null text has none), ``taken`` is size *
    copies.  Null is a source of its own; documents without words have no copies;
    each of several rows alike, and of rows that repeat a doc_id or have none, is
    drawn by itself.  An empty table gives an empty one; other columns of
    ``docs`` play no part.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = _rows(scratch, docs)
    out = _decide(rows, *_plan(scratch, rows))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n")).alias("taken"), F.col("n").alias("copies"), "source")


def remix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as :func:`mix` has copies of it.

    They are written once, beside their sizes and hashes, so that all passes
    read the same rows, whatever ``docs`` is.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = _rows(scratch, docs, F.struct("*").alias("row"))
    out = _decide(rows, *_plan(scratch, rows.drop("row")))
    out = out.where("n > 0").select("row", F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))))
    return out.select("row.*")


def _thresholds(scratch: Scratch, base: DataFrame, plan: DataFrame) -> DataFrame:
    """(name, cut, short): documents of source ``name`` with u < cut have just under ``goal`` tokens, ``short`` too few."""
    state = plan.select(F.col("source").alias("name"), F.lit(0).cast("long").alias("cut"), F.col("goal").alias("short"))
    for digit in (2, 1, 0):
        low = digit * _BINS
        inside = base.join(state, F.col("source").eqNullSafe(F.col("name")))
        inside = inside.where((F.col("size") > 0) & (F.shiftright("u", low + _BINS) == F.shiftright("cut", low + _BINS)))
        bins = inside.groupBy("name", F.shiftright("u", low).alias("bin")).agg(F.sum("size").alias("tokens"), F.first("short").alias("short"))
        upto = Window.partitionBy("name").orderBy("bin")
        bins = bins.withColumn("sum", F.sum("tokens").over(upto))
        # the bin at which the sum passes what is missing; all bins before it are in
        crossing = F.min(F.when(F.col("sum") > F.col("short"), F.struct("bin", (F.col("sum") - F.col("tokens")).alias("into"))))
        found = bins.groupBy("name").agg(crossing.alias("x"), F.max("bin").alias("last"), F.max("sum").alias("all"))
        found = found.select(
            F.col("name").alias("key"),
            F.coalesce(F.shiftleft("x.bin", low), F.shiftleft(F.col("last") + 1, low)).alias("new"), F.coalesce("x.into", "all").alias("into"),
        )
        state = state.join(found, F.col("name").eqNullSafe(F.col("key")), "left")
        state = state.select("name", F.coalesce("new", "cut").alias("cut"), (F.col("short") - F.coalesce("into", F.lit(0))).alias("short"))
        state = scratch.save(state)
    return state


def _fill(base: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows that take up what the thresholds leave short: greedily, the largest of each quarter octave of sizes."""
    open_ = base.join(plan.select(F.col("source").alias("name"), "cut", "short"), F.col("source").eqNullSafe(F.col("name")))
    open_ = open_.where((F.col("u") >= F.col("cut")) & (F.col("size") > 0) & (F.col("size") <= F.col("short")))
    best = open_.groupBy("name", F.floor(4 * F.log2("size")).alias("class"), F.col("u") % 2).agg(
        F.max(F.struct("size", "u", "seq")).alias("x"), F.first("short").alias("short")
    )
    lists = best.groupBy("name").agg(F.sort_array(F.collect_list("x"), asc=False).alias("xs"), F.first("short").alias("short"))
    start = F.struct(F.col("short").alias("left"), F.array().cast("array<bigint>").alias("got"))
    take = lambda s, x: F.when(
        x["size"] <= s["left"], F.struct((s["left"] - x["size"]).alias("left"), F.concat(s["got"], F.array(x["seq"])).alias("got"))
    ).otherwise(s)
    return lists.select(F.explode(F.aggregate("xs", start, take)["got"]).alias("seq"), F.lit(True).alias("filled"))
