"""Token counts: rollups by source, language and tokenizer version, maintained by deltas.

A batch of changes is a table of signed rows: so many inserts (or, negative,
deletes) of a count of tokens, and both for a revised count.  Committing it
aggregates the changes to one additive delta for each key, writes that, and then
creates the batch's marker, which names the delta's folder.  Markers are created
exclusively, so of several attempts at one batch exactly one counts, whether the
others ran before, at the same time or after a lost driver; a delta without a
marker is never read.  (Attempts at the same time need a store whose links or
renames are exclusive, see ``sources.files``: local disks and HDFS; elsewhere run
one at a time.)  Totals are the sum of the committed deltas.  Folding replaces
the deltas so far by their sum and keeps the batches' names.

Counts are the numbers of ids that real vocabularies give.  Copies of a text are
aggregated by text and key before any of them are told apart, so a text that
holds a third of all rows is a few rows.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.files import Folder
from .bpe import encoder
from .shared import ship

KEYS = ["source", "lang", "version"]


class TokenRollup:
    """The rollup in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.files = spark, Folder(spark, path)
        for name in ("delta", "commit", "fold"):
            self.files.make(name)

    @staticmethod
    def _marker(batch: str) -> str:
        return f"commit/{batch.encode().hex()}"

    def _fold(self) -> dict:
        folds = self.files.names("fold")
        return self.files.read(f"fold/{folds[-1]}") if folds else {"batches": [], "delta": None}

    def committed(self) -> list[str]:
        return [bytes.fromhex(n).decode() for n in self.files.names("commit")]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of (source, lang, version, sign, tokens); False if it was committed before.

        Nulls in the keys are keys of their own, null tokens count as 0, and rows
        of null sign are no change.  Repeated rows count each.
        """
        if self.files.exists(self._marker(batch)):
            return False
        sign = F.coalesce(F.col("sign").cast("long"), F.lit(0))
        delta = changes.groupBy(*KEYS).agg(F.sum(sign).alias("docs"), F.sum(sign * F.coalesce(F.col("tokens").cast("long"), F.lit(0))).alias("tokens"))
        folder = f"delta/{uuid.uuid4().hex}"
        delta.write.parquet(f"{self.files.path}/{folder}")
        won = self.files.create(self._marker(batch), {"delta": folder})
        if not won:
            self.files.delete(folder)
        return won

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) of the keys that have either."""
        return self._totals(self.files.names("commit"))

    def _totals(self, commits: list[str]) -> DataFrame:
        fold = self._fold()
        done = set(fold["batches"])
        folders = [self.files.read(f"commit/{n}")["delta"] for n in commits if n not in done]
        folders += [fold["delta"]] if fold["delta"] else []
        schema = "source string, lang string, version string, docs long, tokens long"
        read = self.spark.read.schema(schema)
        deltas = read.parquet(*(f"{self.files.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)
        sums = deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")

    def fold(self) -> None:
        """Replaces the deltas of all batches so far by one; one caller at a time."""
        names, number = self.files.names("commit"), len(self.files.names("fold"))
        folder = f"delta/{uuid.uuid4().hex}"
        self._totals(names).write.parquet(f"{self.files.path}/{folder}")
        self.files.create(f"fold/{number:08d}", {"batches": names, "delta": folder})


def _count(paths: list[str]):
    def run(batches):
        encoders = [encoder(p) for p in paths]
        for batch in batches:
            sizes = [[len(e(t.as_py())) for e in encoders] for t in batch.column("text")]
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sizes, pa.list_(pa.int64()))], names=[*kept, "tokens"])

    return run


def counted(docs: DataFrame, paths: list[str]) -> DataFrame:
    """(doc_id, source, lang, digest, tokens) for each row: a hash of the text, null for none, and its ids in each vocabulary (paths on every machine)."""
    ship(docs.sparkSession)
    string = lambda c: F.col(c).cast("string")
    digest = F.unhex(F.sha2(string("text"), 256)).alias("digest")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), string("source").alias("source"), string("lang").alias("lang"), digest, string("text").alias("text"))
    return base.mapInArrow(_count(paths), "doc_id long, source string, lang string, digest binary, tokens array<long>")


def copies(rows: DataFrame) -> DataFrame:
    """(source, lang, tokens, kept, again) of each text and key of ``rows`` (as :func:`counted` gives them).

    Of the rows of one text that of the smallest doc_id is kept (null last, then
    by source and lang), ``again`` counts the others; rows without a text are no
    copies of each other.  Rows that repeat a doc_id are rows like others.
    """
    key = F.struct(F.col("id").isNull().alias("none"), "id", "source", "lang")
    groups = rows.groupBy("digest", "source", "lang").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.max("tokens").alias("tokens"))
    some = groups.where("digest is not null")
    # a text has as many rows here as keys
    some = some.withColumn("kept", F.when(key == F.min(key).over(Window.partitionBy("digest")), 1).otherwise(0).cast("long"))
    none = groups.where("digest is null").withColumn("kept", F.col("n"))
    return some.unionByName(none).select("source", "lang", "tokens", "kept", (F.col("n") - F.col("kept")).alias("again"))


def signed(rows: DataFrame, sign: Column, tokens: Column, version: str) -> DataFrame:
    """Changes from rows (source, lang, ...): each stands for ``sign`` inserts (negative: deletes) of ``tokens`` tokens."""
    return rows.select("source", "lang", F.lit(version).alias("version"), sign.cast("long").alias("sign"), tokens.alias("tokens"))


def revised(rows: DataFrame, times: Column, old: Column, new: Column, version: str) -> DataFrame:
    """Changes that replace the counts ``old`` by ``new``, ``times`` times each, where they differ."""
    rows = rows.where(~old.eqNullSafe(new) & (times > 0))
    return signed(rows, -times, old, version).unionByName(signed(rows, times, new, version))
