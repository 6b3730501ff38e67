"""A durable collection of versioned documents.

On disk: segments (Parquet, sorted by _id and _version), indexes, a log of
writes that no segment holds yet, and commits.  A commit is one JSON file that
names all that belongs to the collection; creating it is the moment at which a
change happens.  Files that no commit names are never read, so a writer that
dies leaves nothing half done, and readers never wait.
"""

from __future__ import annotations

import math
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DocumentError, EngineError, FieldNotFound, HashMismatch, LogError, SegmentError
from ..functions import lanes as L
from ..functions.fields import DELETED, ID, VERSION, TaggedFields, canonical, tag_of
from ..functions.identity import NIL, new_id
from ..functions.values import LANE, STORED, Tag, Value, decode, encode
from ..operators import compaction as C
from ..operators import indexes as X
from ..operators.traverse import traverse
from ..operators.versions import latest
from ..plans import query as Q
from ..plans.compiler import compile_filter, scan, sort_columns
from ..stats import QueryStats, QueryTimer, pattern_of
from .files import Folder

SCHEMA = f"{ID} string, {VERSION} bigint, {DELETED} boolean, fields map<string,{STORED}>"


@dataclass(frozen=True)
class Config:
    """What can be set of a collection."""

    buffer_rows: int = 10_000  # buffered documents that make a flush
    index_threshold: int = 1000  # returned documents from which a query may build an index
    index_partitions: int = 0  # files of an index; 0: by bytes
    segment_partitions: int = 1  # files of a flush
    file_bytes: int = 128 << 20  # what a file of a merge or an index should have
    w: int = 0
    adaptive: bool = False
    least_w: int = -8
    most_w: int = 8
    w_step: int = 16
    w_cooldown_seconds: float = 900.0
    flush_bytes: int = 16 << 20
    lanes: int = 200  # most fields of a segment that have a typed column of their own
    compaction_threads: int = 4
    inline_compaction: bool = False  # after a flush, where no background compaction runs
    learn: bool = True
    clock: Callable[[], float] = field(default=time.time)


def content_hash():
    """SHA-256 over a document's identity, state and fields."""
    entries = F.array_sort(F.map_entries("fields"))
    return F.sha2(F.concat_ws("\x1f", ID, F.col(VERSION).cast("string"), F.col(DELETED).cast("string"), F.to_json(entries)), 256)


def tag_columns(df: DataFrame, id: str | None = None) -> DataFrame:
    """Documents from a DataFrame of typed columns: (_id, fields); NULLs are missing fields."""
    values = []
    for f in df.schema.fields:
        if f.name == id:
            continue
        tag = tag_of(f.dataType)
        c = F.col(f"`{f.name}`")
        if tag is None:
            tag, c = Tag.STRING, c.cast("string")
        elif tag in (Tag.ARRAY, Tag.DOCUMENT):
            c = canonical(c, f.dataType)
        elif tag == Tag.U64:
            c = c.cast("decimal(20,0)")
        values.append((f.name, tag, c))
    key = F.col(f"`{id}`").cast("string") if id else F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return df.select(key.alias(ID), L.entries(values).alias("fields"))


@dataclass(frozen=True)
class Document:
    """A document as it is read."""

    id: str
    version: int
    fields: dict[str, Value]
    projected: bool = False

    @staticmethod
    def of(row: Row) -> Document:
        d = row.asDict()
        return Document(d[ID], d[VERSION], {k: decode(v) for k, v in sorted((d["fields"] or {}).items())}, bool(d.get("_projected")))

    def get(self, name: str) -> Any:
        v = self.fields.get(name)
        return None if v is None else v.python()

    def extract(self, name: str) -> Value:
        if name not in self.fields:
            raise FieldNotFound(name)
        return self.fields[name]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Document) and self.id == other.id

    def __hash__(self) -> int:
        return hash(self.id)


class Snapshot:
    """A view of a collection as of one version; close it to let compaction go on."""

    def __init__(self, collection: Collection, version: int):
        self.collection, self.version = collection, version

    def get(self, id: str) -> Document | None:
        return self.collection.get(id, self)

    def scan(self, q: Q.Scan | None = None) -> DataFrame:
        return self.collection.scan(q or Q.Scan(), self)

    def traverse(self, q: Q.Traverse) -> DataFrame:
        return self.collection.traverse(q, self)

    def close(self) -> None:
        self.collection._snapshots.pop(id(self), None)

    def __enter__(self) -> Snapshot:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class Collection:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.config, self.files = spark, config or Config(), Folder(spark, path)
        self.stats, self.compaction_stats = QueryStats(), C.CompactionStats()
        self.fields = TaggedFields()
        c = self.config
        self.scaling = C.AdaptiveScaling(c.least_w, c.most_w, c.w_step, c.w_cooldown_seconds, c.clock, c.w, c.w)
        self._lock = threading.RLock()
        self._snapshots: dict[int, int] = {}
        self._pool: ThreadPoolExecutor | None = None
        self._pending: list[Future] = []
        for folder in ("commit", "log", "segment", "index"):
            self.files.make(folder)
        self._load()

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Config | None = None) -> Collection:
        return cls(spark, path, config)

    # -- commits ---------------------------------------------------------------

    def _load(self) -> None:
        commits = self.files.names("commit")
        state = self.files.read(f"commit/{commits[-1]}") if commits else {"seq": 0, "segments": [], "indexes": [], "version": 0, "log": 0}
        self._seq = state["seq"]
        self._segments = [C.Segment(**s) for s in state["segments"]]
        self._indexes = [X.Index(**i) for i in state["indexes"]]
        self._version, self._log_from = state["version"], state["log"]
        self._feeds: dict[str, int] = state.get("feeds", {})
        self._buffer: list[tuple] = []
        self._log_next = self._log_from
        logs = [n for n in self.files.names("log") if not n.startswith(".") and int(n.split(".")[0]) >= self._log_from]
        for at, name in enumerate(logs):
            try:
                rows = [_thaw(row) for row in self.files.read(f"log/{name}")["rows"]]
            except (LogError, DocumentError, KeyError, TypeError, ValueError, Py4JJavaError):
                for n in logs[at:]:  # what was written before it is whole; it and what follows is put aside
                    self.files.move(f"log/{n}", f"damaged/{n}")
                break
            self._buffer += rows
            self._version = max([self._version, *(row[1] for row in rows)])
            self._log_next = int(name.split(".")[0]) + 1

    def _commit(self) -> None:
        self._seq += 1
        state = {
            "seq": self._seq, "segments": [vars(s) for s in self._segments], "indexes": [i.to_dict() for i in self._indexes],
            "version": self._version, "log": self._log_from, "feeds": self._feeds,
        }
        if not self.files.create(f"commit/{self._seq:012d}.json", state):
            raise EngineError("another writer has committed to this collection")

    # -- writing ---------------------------------------------------------------

    def put(self, fields: dict[str, Any], id: str | None = None) -> str:
        """Writes a document; one with the same id is replaced as a whole."""
        return self.put_batch([(id, fields)])[0]

    def put_batch(self, documents: Iterable[tuple[str | None, dict[str, Any]]]) -> list[str]:
        unset = (None, "", NIL)
        rows = [(new_id() if id in unset else id, False, {k: encode(v) for k, v in fields.items()}) for id, fields in documents]
        return self._append(rows)

    def delete(self, id: str) -> None:
        """Writes a tombstone, whether the document is there or not."""
        self._append([(id, True, {})])

    def _append(self, rows: list[tuple]) -> list[str]:
        with self._lock:
            made = []
            for id_, deleted, fields in rows:
                self._version += 1
                made.append((id_, self._version, deleted, fields))
            if made and not self.files.create(f"log/{self._log_next:012d}.json", {"rows": [_freeze(r) for r in made]}):
                raise EngineError("another writer has written to this collection")
            self._log_next += bool(made)
            self._buffer += made
            self.scaling.write(len(made))
            if len(self._buffer) >= self.config.buffer_rows:
                self.flush()
            return [r[0] for r in made]

    def put_frame(self, df: DataFrame, id: str | None = None, feed: tuple[str, int] | None = None) -> None:
        """Writes a DataFrame of typed columns as one batch, without passing through the driver.

        This is the way to ingest at scale: rows go straight into a segment.
        Where an id repeats within the batch, one of its rows is the newest.
        ``feed`` is (name, number) of a batch of a stream; a number that the feed
        has passed already is not written again.
        """
        if feed is not None and feed[1] <= self._feeds.get(feed[0], -1):
            return
        layout = L.of_schema(df.schema, id, self.config.lanes)
        self._append_frame(tag_columns(df, id).select(ID, F.lit(False).alias(DELETED), "fields"), layout, feed)

    def delete_frame(self, ids: DataFrame) -> None:
        """Writes a tombstone for each id of a one-column DataFrame, as one batch."""
        none = F.create_map().cast(f"map<string,{STORED}>")
        self._append_frame(ids.toDF(ID).select(F.col(ID).cast("string"), F.lit(True).alias(DELETED), none.alias("fields")), L.Layout((), True))

    def _append_frame(self, docs: DataFrame, layout: L.Layout, feed: tuple[str, int] | None = None) -> None:
        with self._lock:
            self._flush()
            version = F.lit(self._version + 1) + F.monotonically_increasing_id()
            segment = self._write(docs.select(ID, version.alias(VERSION), DELETED, "fields"), None, layout)
            if segment:
                self._version = segment[1]
                self._segments.append(segment[0])
                self.scaling.write(segment[0].rows)
            if feed is not None:
                self._feeds[feed[0]] = feed[1]
            if segment or feed is not None:
                self._commit()
            if segment:
                self._after_flush()

    def flush(self) -> None:
        """Moves the buffered writes into a segment; compaction follows if it runs in the background or inline."""
        with self._lock:
            if self._flush():
                self._after_flush()

    def _after_flush(self) -> None:
        """One compaction at most, in the background if that runs, else only if the configuration wants it inline."""
        if self._pool is not None:
            self.signal_compaction()
        elif self.config.inline_compaction:
            self.compact()

    def _flush(self) -> bool:
        with self._lock:
            if not self._buffer:
                return False
            written = self._write(self._buffered(), self.config.segment_partitions, self._buffer_layout())
            self._segments.append(written[0])
            old, self._log_from = self._log_from, self._log_next
            self._commit()
            self._buffer = []
            for n in range(old, self._log_from):
                self.files.delete(f"log/{n:012d}.json")
            return True

    def _write(self, rows: DataFrame, parts: int | None, layout: L.Layout) -> tuple[C.Segment, int] | None:
        """A segment of the rows, in files of ranges of _id: as many as named, or as adaptive execution finds fit."""
        name = f"segment/{uuid.uuid4().hex}"
        if parts is None and int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= self.config.flush_bytes:
            parts = 1
        placed = rows.repartition(1) if parts == 1 else rows.repartitionByRange(ID) if parts is None else rows.repartitionByRange(parts, ID)
        seen = Observation()
        # the versions of an id are together and in order already, so counting them moves nothing
        nth = F.row_number().over(Window.partitionBy(ID).orderBy(VERSION))
        sorted_ = placed.withColumn("_nth", nth).sortWithinPartitions(ID, VERSION)
        marks = [F.min(ID).alias("low"), F.max(ID).alias("high"), F.count("*").alias("n"), F.max(VERSION).alias("v")]
        marks += [F.max("_nth").alias("most"), F.count_if(~F.coalesce(F.col(DELETED), F.lit(False))).alias("live")]
        out = L.shred(sorted_.observe(seen, *marks).drop("_nth").withColumn("_hash", content_hash()), layout)
        # a bloom filter on _id serves point lookups, page checksums find damage
        writer = out.write.option("compression", "zstd")
        writer = writer.option(f"parquet.bloom.filter.enabled#{ID}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        writer = writer.option("parquet.page.write-checksum.enabled", "true")
        writer.parquet(f"{self.files.path}/{name}")
        try:
            found = seen.get
        except Py4JJavaError:  # the optimizer saw that there are no rows
            found = {"n": 0}
        if not found["n"]:
            self.files.delete(name)
            return None
        live = found["live"] if found["most"] == 1 else -1
        return C.Segment(name, found["low"], found["high"], self.files.size(name), found["n"], self._seq + 1, live, layout.lanes, layout.closed), found["v"]

    def _files(self, segments: Iterable[C.Segment]) -> int:
        return max(1, math.ceil(sum(s.bytes for s in segments) / self.config.file_bytes))

    # -- reading ---------------------------------------------------------------

    def _segment_frame(self, *names: str, exposed: L.Layout = L.Layout()) -> DataFrame:
        """Rows of segments, with whole documents, and the lanes of ``exposed`` by themselves too."""
        for n in names:
            if not self.files.exists(n):
                raise SegmentError(f"{n} is missing")
        layouts = [s.layout for s in self._segments if s.name in names]
        lanes = L.schema_of(layouts)
        schema = f"{SCHEMA}, _hash string" + (f", {L.LANES} {lanes}" if lanes else "")
        read = self.spark.read.schema(schema).option("parquet.page.verify-checksum.enabled", "true")
        rows = read.parquet(*(f"{self.files.path}/{n}" for n in names))
        typed = {f"_{c}": F.col(L.LANES)[c] for c in (L.column_of(*lane) for lane in exposed.lanes)}
        return rows.select(ID, VERSION, DELETED, L.restored(layouts).alias("fields"), "_hash", *(c.alias(n) for n, c in typed.items()))

    def _buffered(self, exposed: L.Layout = L.Layout()) -> DataFrame:
        rows = self.spark.createDataFrame([Row(*r) for r in self._buffer], SCHEMA)
        return rows.select("*", *(F.col("fields")[n][LANE[Tag(t)]].alias(f"_{L.column_of(n, t)}") for n, t in exposed.lanes))

    def _buffer_layout(self) -> L.Layout:
        return L.of_rows((row[3] for row in self._buffer), self.config.lanes)

    def versions(self, segments: list[str] | None = None, exposed: L.Layout = L.Layout()) -> DataFrame:
        """All stored versions: of the segments named, or of all, and the buffer's."""
        with self._lock:
            names = [s.name for s in self._segments] if segments is None else segments
            parts = [self._segment_frame(*names, exposed=exposed).drop("_hash")] if names else []
            parts += [self._buffered(exposed)] if self._buffer else []
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def frame(self, at: Snapshot | None = None) -> DataFrame:
        """The live documents, of a snapshot or now."""
        return self._live(self._segments, at)

    def _alone(self, segments: list[C.Segment]) -> list[C.Segment]:
        """The segments that hold one version of each id and share ids with no other and not with the buffer."""
        low, high = min((r[0] for r in self._buffer), default=None), max((r[0] for r in self._buffer), default=None)
        out, reach = [], None
        ordered = sorted(segments, key=lambda s: (s.min_id, s.max_id))
        for s, after in zip(ordered, [*ordered[1:], None]):
            apart = (reach is None or reach < s.min_id) and (after is None or s.max_id < after.min_id)
            if apart and s.live >= 0 and (low is None or s.max_id < low or high < s.min_id):
                out.append(s)
            reach = s.max_id if reach is None else max(reach, s.max_id)
        return out

    def _live(self, segments: list[C.Segment], at: Snapshot | None, exposed: L.Layout = L.Layout(), only: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """The live documents of segments and buffer; where an id can't have two versions, none are compared and nothing is shuffled."""
        with self._lock:
            alone = self._alone(segments)
            others = [s.name for s in segments if s not in alone]
            parts = []
            if alone:
                rows = only(self._segment_frame(*(s.name for s in alone), exposed=exposed).drop("_hash"))
                rows = rows.where(~F.coalesce(F.col(DELETED), F.lit(False)))
                parts.append(rows.where(F.col(VERSION) <= at.version) if at else rows)
            if others or self._buffer or not alone:
                parts.append(latest(only(self.versions(others, exposed)), at.version if at else None))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def get(self, id: str, at: Snapshot | None = None) -> Document | None:
        timer = QueryTimer(self.stats, pattern_of(Q.Get(id)))
        self.scaling.read()
        row = self.range(id, id, at).first()
        timer.done(1, int(row is not None))
        return Document.of(row) if row else None

    def range(self, low: str, high: str, at: Snapshot | None = None) -> DataFrame:
        """The live documents with low <= _id <= high, from the segments whose ids reach into that range."""
        with self._lock:
            reached = [s for s in self._segments if s.min_id <= high and low <= s.max_id]
            return self._live(reached, at, only=lambda rows: rows.where(F.col(ID).between(low, high)))

    def contains(self, id: str) -> bool:
        return self.get(id) is not None

    def snapshot(self) -> Snapshot:
        with self._lock:
            s = Snapshot(self, self._version)
            self._snapshots[id(s)] = s.version
            return s

    @property
    def oldest_snapshot(self) -> int | None:
        return min(self._snapshots.values(), default=None)

    def scan(self, q: Q.Scan, at: Snapshot | None = None) -> DataFrame:
        """A lazy scan; an index serves it if one fits and no snapshot is asked for."""
        rows, _, fields = self._source(q, at)
        return _plain(scan(rows, q, fields), q)

    def _source(self, q: Q.Scan, at: Snapshot | None) -> tuple[DataFrame, X.Index | None, TaggedFields]:
        index = self._choose(q) if at is None else None
        if index is None:
            with self._lock:
                exposed = L.joint([s.layout for s in self._segments] + ([self._buffer_layout()] if self._buffer else []))
                lanes = {n: (Tag(t), f"_{L.column_of(n, t)}") for n, t in exposed.lanes}
                return self._live(self._segments, at, exposed), None, TaggedFields(lanes=lanes)
        index.used(self.config.clock())
        with self._lock:
            current = not self._buffer and {s.name for s in self._segments} <= set(index.covers)
        if not q.sort:
            rows = X.prune(self._index_frame(index), q.filter)
        elif current and q.limit is not None and not q.sort[0].descending and (q.filter is None or index.predicate is not None):
            rows = self._index_frame(index, q.limit)  # all its rows match, and no later write moves one
        else:
            rows = self._index_frame(index)
        return X.with_tail(rows, self._tail(index)), index, self.fields

    def _choose(self, q: Q.Scan) -> X.Index | None:
        with self._lock:
            if q.sort and len({s.descending for s in q.sort}) == 1:
                fields = [s.field for s in q.sort]
                return next((i for i in self._indexes if i.serves_sort(fields, q.filter)), None)
            if not q.sort and isinstance(q.filter, (Q.Eq, Q.Gt, Q.Lt, Q.Range)):
                return next((i for i in self._indexes if i.serves_filter(q.filter)), None)
        return None

    def traverse(self, q: Q.Traverse, at: Snapshot | None = None) -> DataFrame:
        return traverse(self.frame(at), q, self.fields)

    def execute(self, q: Q.Query, at: Snapshot | None = None) -> DataFrame:
        """The DataFrame of any query."""
        if isinstance(q, Q.Get):
            return self.range(q.id, q.id, at)
        return self.scan(q, at) if isinstance(q, Q.Scan) else self.traverse(q, at)

    def run(self, q: Q.Query, at: Snapshot | None = None) -> list[Document]:
        """Runs a query now, returns its documents, and learns from it."""
        if isinstance(q, Q.Get):
            found = self.get(q.id, at)
            return [found] if found else []
        self.scaling.read()
        timer = QueryTimer(self.stats, pattern_of(q))
        if isinstance(q, Q.Traverse):
            out = [Document.of(r) for r in self.traverse(q, at).collect()]
            timer.done(0, len(out))
            return out
        with self._lock:
            rows, index, fields = self._source(q, at)
            known = at is None and not self._buffer and len(self._alone(self._segments)) == len(self._segments)
            live = sum(s.live for s in self._segments)
        read, passed = Observation(), Observation()
        if not known or index:  # a count of what is read would keep the filter from the scan
            rows = rows.observe(read, F.count(F.lit(1)).alias("n"))
        if q.filter is not None:
            rows = rows.where(compile_filter(q.filter, fields))
        rows = rows.observe(passed, F.count(F.lit(1)).alias("n"))
        out = [Document.of(r) for r in _plain(scan(rows, replace(q, filter=None), fields), q).collect()]
        scanned, matched = live if known and not index else _seen(read), _seen(passed)
        timer.done(len(out) if index else scanned, len(out))
        if self.config.learn and at is None and index is None:
            self._learn(q, matched, len(out))
        return out

    # -- indexes ---------------------------------------------------------------

    def _learn(self, q: Q.Scan, matched: int, returned: int) -> None:
        limit = self.config.index_threshold
        if q.sort and len({s.descending for s in q.sort}) == 1:
            if matched > limit:
                self.build_index([s.field for s in q.sort], q.filter)
        elif not q.sort and isinstance(q.filter, (Q.Eq, Q.Gt, Q.Lt, Q.Range)) and returned > limit:
            s = self.stats.get(pattern_of(q))
            if s.count >= 2 and s.selectivity <= 0.5 and not self.has_index([q.filter.field]):
                self.build_index([q.filter.field])

    def has_index(self, fields: list[str]) -> bool:
        return any(i.fields == list(fields) for i in self._indexes)

    @property
    def indexes(self) -> list[X.Index]:
        return list(self._indexes)

    def _index_frame(self, index: X.Index, first: int | None = None) -> DataFrame:
        """The rows of an index, or those of the files that hold its first ones."""
        path = f"{self.files.path}/{index.name}"
        return self.spark.read.parquet(*([path] if first is None or not index.files else [f"{path}/{n}" for n in index.first_files(first)]))

    def _tail(self, index: X.Index) -> DataFrame:
        covered = set(index.covers)
        return self.versions([s.name for s in self._segments if s.name not in covered])

    def build_index(self, fields: list[str], predicate: Q.Filter | dict | None = None) -> X.Index:
        """Builds an index over the latest documents (never over a snapshot's) and commits it."""
        with self._lock:
            self._flush()
            f = X.load_filter(predicate) if isinstance(predicate, dict) else predicate
            docs = self.frame()
            if f is not None:
                docs = docs.where(compile_filter(f, self.fields))
            name = f"index/{uuid.uuid4().hex}"
            X.build(docs, list(fields), self.config.index_partitions or self._files(self._segments)).write.parquet(f"{self.files.path}/{name}")
            file = F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")
            counts = self.spark.read.parquet(f"{self.files.path}/{name}").groupBy(file).count().collect()  # a row per file
            files = sorted([r["file"], r["count"]] for r in counts)
            index = X.Index(name, list(fields), X.dump_filter(f), [s.name for s in self._segments], sum(n for _, n in files), 0, self.config.clock(), files)
            self._indexes = [i for i in self._indexes if (i.fields, i.predicate) != (index.fields, index.predicate)] + [index]
            self._commit()
            return index

    def maintain_indexes(self) -> None:
        """Drops what is unused, joins partial indexes on the same fields, and takes in long tails."""
        with self._lock:
            now = self.config.clock()
            self._indexes = [i for i in self._indexes if not i.to_drop(now)]
            by_fields: dict[tuple, list[X.Index]] = {}
            for i in self._indexes:
                by_fields.setdefault(tuple(i.fields), []).append(i)
            self._commit()
            for fields, group in by_fields.items():
                if len(group) > 1:
                    predicate = X.merged_predicate(group)
                    self._indexes = [i for i in self._indexes if i not in group]
                    self.build_index(list(fields), predicate)
                elif len(group[0].covers) < len(self._segments) or self._buffer:
                    index = group[0]
                    pending = self._tail(index).count()
                    full = X.rebuild_pays(pending, index.rows) and X.widen_pays(pending, index.rows)
                    self._indexes.remove(index)
                    self.build_index(list(fields), None if full else index.predicate)

    # -- compaction --------------------------------------------------------------

    def policy(self) -> C.UnifiedPolicy:
        return C.UnifiedPolicy(self.scaling.w, self.config.flush_bytes)

    def compact(self, transform: C.CompactionFilter | None = None) -> bool:
        """Merges the group that the policy picks and tends the indexes; False if there is none."""
        with self._lock:
            if self.config.adaptive:
                self.scaling.adjust()
            pick = self.policy().pick(self._segments)
            if pick is None:
                return False
            self.merge_segments(list(pick.segments), transform)
            if self._indexes:
                self.maintain_indexes()
            return True

    def merge_segments(self, segments: list[C.Segment], transform: C.CompactionFilter | None = None) -> None:
        with self._lock:
            bounds = sorted(set(self._snapshots.values()))
            names = {s.name for s in segments}
            newest = max(s.seq for s in segments)
            low, high = min(s.min_id for s in segments), max(s.max_id for s in segments)
            older = [s for s in self._segments if s.name not in names and s.seq <= newest and s.min_id <= high and low <= s.max_id]
            rows = C.merge(self._segment_frame(*sorted(names)).drop("_hash"), bounds, not older and not bounds, transform)
            layout = L.Layout() if transform else L.joint([s.layout for s in segments])
            written = self._write(rows, self._files(segments), layout)
            kept = [s for s in self._segments if s.name not in names]
            self._segments = kept + ([replace(written[0], seq=newest)] if written else [])
            fresh = []
            for i in self._indexes:
                covered = set(i.covers)
                i.unused_compactions += 1
                if names <= covered:  # the merged segment holds what the index has seen
                    i.covers = [c for c in i.covers if c not in names] + ([written[0].name] if written else [])
                    fresh.append(i)
                elif not names & covered:
                    fresh.append(i)
            gone = [i for i in self._indexes if i not in fresh]
            self._indexes = fresh
            self._commit()
            st = self.compaction_stats
            st.runs += 1
            st.segments_read += len(segments)
            st.bytes_read += sum(s.bytes for s in segments)
            if written:
                st.segments_written += 1
                st.bytes_written += written[0].bytes
            for i in gone:  # an index that covers a part of the merge is built anew
                self.build_index(i.fields, i.predicate)

    def start_background_compaction(self) -> None:
        if self._pool is None:
            self._pool = ThreadPoolExecutor(self.config.compaction_threads, thread_name_prefix="compaction")

    def signal_compaction(self) -> None:
        if self._pool is not None:
            self._pending = [f for f in self._pending if not f.done()] + [self._pool.submit(self.compact)]

    def wait_for_compaction(self) -> None:
        for f in list(self._pending):
            f.result()

    def vacuum(self) -> list[str]:
        """Deletes segments and indexes that the last commit doesn't name; no snapshot may be open."""
        if self._snapshots:
            raise EngineError("snapshots are open")
        with self._lock:
            named = {s.name for s in self._segments} | {i.name for i in self._indexes}
            gone = [f"{d}/{n}" for d in ("segment", "index") for n in self.files.folders(d) if f"{d}/{n}" not in named]
            for name in gone:
                self.files.delete(name)
            return gone

    # -- checks and gauges -------------------------------------------------------

    def verify(self) -> None:
        """Compares the stored hash of every version with its content."""
        names = [s.name for s in self._segments]
        if names:
            try:
                bad = self._segment_frame(*names).where(F.col("_hash") != content_hash()).select(ID).first()
            except (PySparkException, Py4JJavaError) as e:  # a page's checksum, or no Parquet at all
                raise SegmentError(f"a segment can't be read: {e}") from e
            if bad:
                raise HashMismatch(bad[ID])

    def sync(self) -> None:
        """Nothing to do: a write is in the log before put returns."""

    @property
    def segment_count(self) -> int:
        return len(self._segments)

    @property
    def segments(self) -> list[C.Segment]:
        return list(self._segments)

    @property
    def buffered(self) -> int:
        return len(self._buffer)

    @property
    def effective_w(self) -> int:
        return self.scaling.w

    @property
    def target_w(self) -> int:
        return self.scaling.target

    def close(self) -> None:
        self.wait_for_compaction()
        if self._pool is not None:
            self._pool.shutdown()
            self._pool = None
        self._flush()


def _plain(docs: DataFrame, q: Q.Scan) -> DataFrame:
    """Documents without the lanes that a scan has used."""
    return docs.select(ID, VERSION, DELETED, "fields", *(["_projected"] if q.project is not None else []))


def _seen(rows: Observation) -> int:
    """Rows that an action has passed; none where the optimizer saw that the result is empty."""
    try:
        return rows.get["n"]
    except Py4JJavaError:
        return 0


def _freeze(row: tuple) -> list:
    """A buffered row as JSON: values as canonical text."""
    id_, version, deleted, fields = row
    return [id_, version, deleted, {k: decode(v).canonical() for k, v in fields.items()}]


def _thaw(row: list) -> tuple:
    from ..functions.values import _from_canonical

    id_, version, deleted, fields = row
    return id_, version, deleted, {k: encode(_from_canonical(v)) for k, v in fields.items()}


__all__ = ["Collection", "Config", "Document", "Snapshot", "content_hash", "sort_columns", "tag_columns", "T"]
