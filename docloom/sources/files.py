"""Small files in any store that Spark reaches, and tables in the shared folder."""

from __future__ import annotations

import json
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..errors import EngineError, LogError

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; where that is unset, on one machine only, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault("dir", f"file://{tempfile.mkdtemp(prefix='docloom-')}")
    return base.rstrip("/")


class Folder:
    """JSON files under ``path``, created at once or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def make(self, name: str = "") -> None:
        self._fs.mkdirs(self._at(name))

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def folders(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name)) if s.isDirectory()) if self.exists(name) else []

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._at(name)).getLength()

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def delete_on_exit(self) -> None:
        self._fs.deleteOnExit(self._at(""))

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError as e:
            raise LogError(f"{self.path}/{name} isn't JSON") from e
        finally:
            stream.close()

    def create(self, name: str, content: dict) -> bool:
        """Writes a new file; False if there is one of that name.

        The content goes to a temporary name first, so a reader never sees half
        of it.  On local disks a hard link then gives it its name, elsewhere a
        rename; of several writers at once one wins where links or renames fail
        on a taken name, as on local disks and HDFS.  Object stores whose rename
        is a copy promise no more than the check before it: use one writer there.
        """
        if self.exists(name):
            return False
        part = f".{uuid.uuid4().hex}.tmp"
        stream = self._fs.create(self._at(part), False)
        stream.write(json.dumps(content).encode())
        stream.close()
        if self._fs.getScheme() == "file":
            won = self._link(part, name)
        elif not self.exists(name) and self._fs.rename(self._at(part), self._at(name)):
            return True
        else:
            won = False
        self._fs.delete(self._at(part), False)
        return won

    def _link(self, part: str, name: str) -> bool:
        jvm = self.spark._jvm
        place = lambda n: jvm.java.io.File(self._at(n).toUri().getPath()).toPath()
        try:
            jvm.java.nio.file.Files.createLink(place(name), place(part))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                return False
            raise
        return True

    def move(self, name: str, to: str) -> None:
        self.make(to.rpartition("/")[0])
        self._fs.rename(self._at(name), self._at(to))


class Scratch:
    """Written tables of one query, deleted when the session ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = Folder(spark, f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex[:12]}")
        self.folder.make()
        self.folder.delete_on_exit()
        self._n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.folder.path}/{self._n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
