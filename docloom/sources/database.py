"""A database: named collections under one folder, and a system collection that describes them."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

from ..errors import UnsupportedOperation
from ..plans import query as Q
from .collection import Collection, Config
from .files import Folder

SYSTEM = "system"
R = TypeVar("R")


class Database:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.config, self.files = spark, config or Config(), Folder(spark, path)
        self.files.make()
        self._open = {name: self._at(name) for name in {SYSTEM, *self.files.folders()}}

    def _at(self, name: str) -> Collection:
        return Collection(self.spark, f"{self.files.path}/{name}", self.collection_config(name))

    @property
    def data_dir(self) -> str:
        return self.files.path

    def collection_config(self, name: str) -> Config:
        return self.config

    def collection(self, name: str) -> Collection:
        """The collection of that name, made if there is none."""
        if name not in self._open:
            self._open[name] = self._at(name)
        return self._open[name]

    def __getitem__(self, name: str) -> Collection:
        return self.collection(name)

    def with_collection(self, name: str, use: Callable[[Collection], R]) -> R:
        """Calls ``use`` with a collection and then records the indexes that it has built."""
        out = use(self.collection(name))
        self.record_indexes(name)
        return out

    def record_indexes(self, name: str) -> None:
        system, here = self.collection(SYSTEM), self.collection(name)
        known = {d.get("path"): d.id for d in system.run(Q.Scan(Q.And(Q.Eq("type", "index"), Q.Eq("collection", name))))}
        now = {i.name: i for i in here.indexes}
        for path in known.keys() - now.keys():
            system.delete(known[path])
        new = [(None, {"type": "index", "collection": name, "fields": ",".join(now[p].fields), "path": p}) for p in sorted(now.keys() - known.keys())]
        if new:
            system.put_batch(new)

    @property
    def system(self) -> Collection:
        return self._open[SYSTEM]

    def list_collections(self) -> list[str]:
        return sorted(self._open)

    def drop_collection(self, name: str) -> None:
        """Deletes a collection, if there is one."""
        if name == SYSTEM:
            raise UnsupportedOperation("the system collection can't be dropped")
        self._open.pop(name, None)
        self.files.delete(name)

    def close(self) -> None:
        for c in self._open.values():
            c.close()
