"""Intermediate tables in the folder that the driver and all executors share.

Writing a table cuts the lineage, so a lost executor costs at most the stage
that runs at that moment, and a retried task reads the same rows again.  The
folder is the session's ``spark.checkpoint.dir``; only where that is unset (in
tests, on one machine) a temporary one is made.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import Folder, shared_dir

_shipped: set[str] = set()


#: Rows and bytes of an Arrow batch, at most: a Python worker holds few of them, whatever a row weighs.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20


def _small_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of a batch to these, unless they are lower."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python workers, once for each context."""
    _small_batches(spark)
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        target = f"{tempfile.mkdtemp(prefix='docloom-')}/docloom.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        context.addPyFile(target)
        _shipped.add(context.applicationId)
    return spark


class Scratch:
    """The written tables of one operator run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = ship(spark)
        self.folder = Folder(spark, f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex[:12]}")
        self.folder.make()
        self.folder.delete_on_exit()
        self._n = 0

    @property
    def root(self) -> str:
        return self.folder.path

    def save(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` and reads it back."""
        self._n += 1
        df.write.option("compression", "zstd").parquet(f"{self.root}/{self._n}")
        out = self.spark.read.schema(df.schema).parquet(f"{self.root}/{self._n}")
        out._docloom_table = str(self._n)
        return out

    def free(self, *tables: DataFrame | None) -> None:
        """Deletes tables that nothing reads any more."""
        for df in tables:
            name = getattr(df, "_docloom_table", None)
            if name:
                self.folder.delete(name)
