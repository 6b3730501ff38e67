from __future__ import annotations

import uuid

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docloom.errors import EngineError, FieldNotFound, SegmentError, UnsupportedOperation
from docloom.functions import identity
from docloom.plans import query as Q
from docloom.functions.fields import TaggedFields
from docloom.operators.versions import retain
from docloom.plans.compiler import compile_filter, scan
from docloom.sources.collection import Collection, Config, Document
from docloom.sources.database import Database
from docloom.sources.files import Folder


def ns(found):
    return [d.get("n") for d in found]


def fill(c, n=10):
    return c.put_batch((f"{i + 1:032x}", {"n": i, "category": ("electronics", "books")[i % 2]}) for i in range(n))


def test_documents_versions_and_snapshots(spark, folder):
    c = Collection.open(spark, f"{folder}/c", Config(learn=False))
    ids = fill(c)
    assert ns(c.run(Q.Scan(Q.Gt("n", 6)))) == [7, 8, 9]
    with c.snapshot() as old:
        c.put({"other": 1}, ids[3])
        c.delete(ids[4])
        c.delete("0" * 31 + "f")
        assert old.get(ids[3]).get("n") == 3 and old.get(ids[4]).get("n") == 4 and old.scan().count() == 10
        assert c.get(ids[3]).get("n") is None and c.get(ids[3]).get("other") == 1
        assert c.get(ids[4]) is None and not c.contains(ids[4]) and c.frame().count() == 9
        c.flush()
        c.put({"n": 44}, ids[4])
        c.flush()
        c.merge_segments(c.segments)
        assert c.segment_count == 1 and old.get(ids[4]).get("n") == 4 and old.get(ids[3]).get("n") == 3
    assert c.get(ids[4]).get("n") == 44
    c.merge_segments(c.segments)
    assert c.versions().count() == 10
    c.verify()
    with pytest.raises(FieldNotFound):
        c.get(ids[0]).extract("nothing")
    assert c.run(Q.Scan(Q.Eq("n", 5), project=("n",)))[0].projected


def test_writes_survive_reopening(spark, folder):
    c = Collection.open(spark, f"{folder}/c")
    ids = fill(c)
    c.flush()
    c.put({"x": [1, {"y": b"\x00"}], "ref": uuid.UUID(int=7)}, ids[0])
    again = Collection.open(spark, f"{folder}/c")
    assert again.buffered == 1 and again.get(ids[0]).get("x") == [1, {"y": b"\x00"}]
    again.files.make("segment/torn")  # a writer that died before its commit
    assert Collection.open(spark, f"{folder}/c").frame().count() == 10
    assert "segment/torn" in again.vacuum()
    with pytest.raises(EngineError):
        c.put({"n": 1})
        c.flush()
        again.put({"n": 2})
        again.flush()


def test_indexes_give_the_same_answers(spark, folder):
    c = Collection.open(spark, f"{folder}/c", Config(index_threshold=3))
    ids = fill(c)
    by_n = Q.Scan(sort=(Q.SortField("n", True),), limit=3)
    assert ns(c.run(by_n)) == [9, 8, 7] and c.has_index(["n"])
    c.put({"n": 50}, ids[0])
    c.put({"n": 51}, ids[0])
    c.delete(ids[9])
    assert ns(c.run(by_n)) == [51, 8, 7]
    books = Q.Scan(Q.Eq("category", "books"))
    first = ns(c.run(books))
    assert not c.has_index(["category"])
    assert ns(c.run(books)) == first and c.has_index(["category"])
    assert sorted(ns(c.run(books))) == [1, 3, 5, 7]
    c.flush()
    assert sorted(ns(c.run(Q.Scan(Q.Range("n", 5, 52))))) == [5, 6, 7, 8, 51]
    c.merge_segments(c.segments)
    assert ns(c.run(by_n)) == [51, 8, 7] and c.has_index(["n"])
    with c.snapshot() as s:
        assert s.scan(by_n).count() == 3
    assert ns(c.run(Q.Scan(sort=(Q.SortField("n"),), limit=0))) == [] and ns(c.run(Q.Scan(Q.Or()))) == []


def test_equal_keys_and_disjoint_partial_ranges(spark, folder):
    c = Collection.open(spark, f"{folder}/c", Config(learn=False))
    c.put_batch((f"{i + 1:032x}", {"n": i // 4}) for i in range(12))
    c.build_index(["n"], Q.Lt("n", 1))
    c.build_index(["n"], Q.Gt("n", 1))
    c.maintain_indexes()
    assert len(c.indexes) == 1 and c.indexes[0].predicate is not None
    assert len(c.run(Q.Scan(Q.Eq("n", 1)))) == 4  # outside both ranges
    assert len(c.run(Q.Scan(sort=(Q.SortField("n"),)))) == 12


def test_traverse(spark, folder):
    c = Collection.open(spark, f"{folder}/c")
    a, b, d = (uuid.UUID(int=i) for i in (1, 2, 3))
    c.put_batch([(a.hex, {"name": "ceo"}), (b.hex, {"name": "vp", "boss": a}), (d.hex, {"name": "dev", "boss": b})])
    walk = lambda depth: [x.get("name") for x in c.run(Q.Traverse(Q.Eq("name", "dev"), "boss", "_id", depth))]
    assert walk(0) == [] and walk(1) == ["vp"] and walk(2) == ["vp", "ceo"] and walk(9) == ["vp", "ceo"]
    c.put({"name": "ceo", "boss": d}, a.hex)  # a cycle leads back to the start
    assert walk(9) == ["vp", "ceo", "dev"]
    assert c.traverse(Q.Traverse(None, "_id", "_id", 1)).count() == 3


def test_stats_count_exactly(spark, folder):
    c = Collection.open(spark, f"{folder}/c", Config(learn=False))
    c.put_batch((None, {"age": i}) for i in range(20))
    for _ in range(3):
        c.run(Q.Scan(Q.Gt("age", 15)))
    ((pattern, s),) = c.stats.top_by_count(1)
    assert pattern.filter_fields == ("age",) and (s.count, s.scanned, s.returned) == (3, 60, 12) and s.selectivity == 0.2


def test_frames_deletes_and_feeds(spark, folder):
    c = Collection.open(spark, f"{folder}/c")
    df = spark.range(10).selectExpr("id", "id * 2 AS n", "CASE WHEN id > 5 THEN 'x' END AS s")
    c.put_frame(df, "id", ("f", 0))
    c.put_frame(df.where("id < 3"), "id", ("f", 0))  # repeated: not written
    c.delete_frame(df.where("id = 7").select("id"))
    assert c.frame().count() == 9 and c.run(Q.Scan(Q.Exists("s")))[0].get("s") == "x" and len(c.run(Q.Scan(Q.Exists("s")))) == 3
    assert c.segment_count == 2


def test_streams(spark, folder, tmp_path):
    from docloom.streaming.feed import feed

    spark.range(6).selectExpr("id", "id + 1 AS n").write.parquet(f"{tmp_path}/in")
    c = Collection.open(spark, f"{folder}/c")
    stream = spark.readStream.schema("id long, n long").parquet(f"{tmp_path}/in")
    feed(stream, c, "id", "numbers", f"{folder}/check", once=True).awaitTermination()
    assert sorted(ns(c.run(Q.Scan()))) == [1, 2, 3, 4, 5, 6]


def test_database(spark, folder):
    db = Database(spark, f"{folder}/db")
    db["b"].put({"x": 1})
    db.with_collection("a", lambda c: (c.put({"x": 1}), c.build_index(["x"])))
    assert db.list_collections() == ["a", "b", "system"]
    meta = db.system.run(Q.Scan(Q.Eq("type", "index")))
    assert [(d.get("collection"), d.get("fields")) for d in meta] == [("a", "x")]
    with pytest.raises(UnsupportedOperation):
        db.drop_collection("system")
    db.drop_collection("nothing")
    db.drop_collection("b")
    again = Database(spark, f"{folder}/db")
    assert again.list_collections() == ["a", "system"] and len(again["a"].indexes) == 1


def test_ids():
    made = [identity.new_id() for _ in range(1000)]
    assert made == sorted(set(made)) and all(identity.NIL < i < identity.LATEST for i in made)
    assert identity.from_bytes(identity.as_bytes(made[0])) == made[0] and uuid.UUID(made[0]).version == 7


def test_background_compaction(spark, folder):
    c = Collection.open(spark, f"{folder}/c", Config(flush_bytes=1 << 20))
    for n in range(3):
        c.put_batch((f"{i + 1:032x}", {"n": n}) for i in range(3))
        c.flush()
    c.start_background_compaction()
    c.signal_compaction()
    c.wait_for_compaction()
    assert c.segment_count == 1 and c.compaction_stats.runs == 1 and c.versions().count() == 3
    c.close()


@pytest.mark.parametrize("inline", [True, False])
def test_flushes_compact_and_tend_indexes(spark, folder, inline):
    c = Collection.open(spark, f"{folder}/c", Config(learn=False, inline_compaction=inline, flush_bytes=1 << 20))
    if not inline:
        c.start_background_compaction()
    ids = fill(c)
    c.build_index(["category"])
    for n in range(4):
        c.put({"n": 100 + n, "category": "books"}, ids[n])
        c.flush()
    c.put_frame(spark.createDataFrame([(ids[9], 9, "books")], "id string, n long, category string"), "id")
    c.wait_for_compaction()
    assert c.segment_count < 6 and c.compaction_stats.runs > 0
    assert len(c.indexes) == 1 and set(c.indexes[0].covers) & {s.name for s in c.segments}
    assert sorted(ns(c.run(Q.Scan(Q.Eq("category", "books"))))) == [5, 7, 9, 100, 101, 102, 103]
    c.verify()
    c.close()


def test_ingest_and_merges_are_cut_by_ids_and_bytes(spark, folder):
    """Files of a segment hold ranges of ids, merges have files by their bytes, and reads of a range skip segments."""
    c = Collection.open(spark, f"{folder}/c", Config(file_bytes=20_000, flush_bytes=20_000))
    rows = spark.range(20_000).selectExpr("lpad(id, 8, '0') AS k", "id AS n", "sha2(string(id), 256) AS s")
    c.put_frame(rows.where("n < 15000").repartition(5), "k")
    c.put_frame(rows.where("n >= 15000").repartition(5), "k")
    low, high = c.segments
    assert (low.min_id, low.max_id, low.rows) == ("00000000", "00014999", 15_000) and high.min_id == "00015000"
    c.merge_segments(c.segments)
    (one,) = c.segments
    files = [r for r in spark.read.parquet(f"{c.files.path}/{one.name}").selectExpr("input_file_name() AS f", "_id").groupBy("f").agg({"_id": "min"}).collect()]
    assert len(files) >= 5 and one.rows == 20_000
    spans = spark.read.parquet(f"{c.files.path}/{one.name}").selectExpr("input_file_name() AS f", "_id").groupBy("f").agg(F.min("_id").alias("low"), F.max("_id").alias("high")).orderBy("low").collect()
    assert all(a["high"] < b["low"] for a, b in zip(spans, spans[1:]))
    assert c.range("00000010", "00000019").count() == 10 and c.range("x", "y").count() == 0 and c.get("00019999").get("n") == 19_999
    plan = c.range("00000010", "00000019")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(_id), GreaterThanOrEqual(_id,00000010), LessThanOrEqual(_id,00000019)]" in plan
    c.put({"n": -1}, "00000012")
    c.delete("00000013")
    assert sorted(ns(map(Document.of, c.range("00000011", "00000014").collect()))) == [-1, 11, 14]


def test_damaged_pages_are_found(spark, tmp_path):
    c = Collection.open(spark, f"file://{tmp_path}/c")
    c.put_frame(spark.range(5000).selectExpr("id AS k", "sha2(string(id), 512) AS s"), "k")
    c.verify()
    (part,) = (tmp_path / "c" / c.segments[0].name).glob("*.parquet")
    raw, column = bytearray(part.read_bytes()), pq.ParquetFile(part).metadata.row_group(0).column(0)
    assert column.path_in_schema == "_id"
    raw[column.data_page_offset + column.total_compressed_size // 2] ^= 0x01
    part.write_bytes(bytes(raw))
    (part.parent / f".{part.name}.crc").unlink()
    with pytest.raises(SegmentError):
        Collection.open(spark, f"file://{tmp_path}/c").verify()


def test_a_damaged_log_keeps_what_was_before(spark, folder):
    c = Collection.open(spark, f"{folder}/c")
    for n in range(4):
        c.put({"n": n}, f"id{n}")
    name = c.files.names("log")[2]
    c.files.delete(f"log/{name}")
    stream = c.files._fs.create(c.files._at(f"log/{name}"), False)
    stream.write(b'{"rows": [["id2", 3, fal')
    stream.close()
    again = Collection.open(spark, f"{folder}/c")
    assert sorted(ns(map(Document.of, again.frame().collect()))) == [0, 1] and len(again.files.names("damaged")) == 2
    again.put({"n": 7}, "id7")
    assert sorted(ns(map(Document.of, Collection.open(spark, f"{folder}/c").frame().collect()))) == [0, 1, 7]


def test_of_many_creators_one_wins(spark, folder):
    from concurrent.futures import ThreadPoolExecutor

    files = Folder(spark, f"{folder}/f")
    files.make()
    with ThreadPoolExecutor(8) as pool:
        for n in range(10):
            assert sum(pool.map(lambda i: files.create(f"x{n}", {"by": i}), range(8))) == 1
    assert files.names() == sorted(f"x{n}" for n in range(10))


def test_retention_keeps_what_each_bound_sees(spark):
    import random

    rng = random.Random(2)
    rows = [(f"k{rng.randrange(6)}", v) for v in rng.sample(range(1000), 300)] + [("hot", v) for v in range(1000, 1600)]
    df = spark.createDataFrame(rows, "_id string, _version long")
    for bounds in ([], [100], [100, 500, 1200], [5000]):
        want = set()
        for b in [*bounds, 10**6]:
            for k in {k for k, _ in rows}:
                want |= {(k, max(v for x, v in rows if x == k and v <= b))} if any(x == k and v <= b for x, v in rows) else set()
        got = [tuple(r) for r in retain(df, bounds).collect()]
        assert set(got) == want and len(got) == len(want)


def test_limits_read_the_first_files_of_an_index(spark, folder):
    c = Collection.open(spark, f"{folder}/c", Config(learn=False, index_partitions=5))
    c.put_frame(spark.range(1000).selectExpr("lpad(id, 4, '0') AS k", "CASE WHEN id % 10 <> 0 THEN (id * 7) % 1000 END AS n"), "k")
    c.build_index(["n"])
    assert len(c.indexes[0].files) == 5 and c.indexes[0].rows == 1000
    for q, files in ((Q.Scan(sort=(Q.SortField("n"),), limit=20), 1), (Q.Scan(sort=(Q.SortField("n"),), limit=450), 3), (Q.Scan(sort=(Q.SortField("n", True),), limit=20), 5), (Q.Scan(sort=(Q.SortField("n"),)), 5)):
        got = c.scan(q)
        assert len([f for f in got.inputFiles() if "/index/" in f]) <= files
        want = [tuple(r) for r in scan(c.frame(), q, TaggedFields()).select("_id").collect()]
        assert [tuple(r) for r in got.select("_id").collect()] == want
    c.put({"n": -5}, "0001")
    q = Q.Scan(sort=(Q.SortField("n"),), limit=3)
    assert [d.id for d in c.run(q)][0] == "0001" and [d.id for d in Collection.open(spark, f"{folder}/c").run(q)][0] == "0001"


def test_filters_and_columns_reach_the_files_of_a_collection(spark, folder):
    """Where no id has two versions, a scan shuffles nothing, pushes its filter and reads the fields it names only."""
    c = Collection.open(spark, f"{folder}/c", Config(learn=False))
    c.put_frame(spark.range(2_000).selectExpr("lpad(id, 8, '0') AS k", "id AS n", "sha2(string(id), 256) AS s", "id / 7 AS d"), "k")
    q = Q.Scan(Q.And(Q.Gt("n", 10), Q.Lt("d", 3.0)), project=("n",))
    plan = c.scan(q)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(lanes.i_n,10)" in plan and "LessThan(lanes.d_d,3.0)" in plan
    read = plan.split("ReadSchema: ")[1]
    assert "lanes:struct<i_n:bigint,d_d:double>" in read and "fields" not in read and "Exchange" not in plan
    assert ns(c.run(q)) == list(range(11, 21)) and c.scan(q).columns == ["_id", "_version", "_deleted", "fields", "_projected"]
    c.put({"n": 15}, id="00000003")  # a second version: the buffer's
    assert ns(c.run(q)) == list(range(11, 21))
    assert ns(c.run(Q.Scan(Q.Eq("n", 15)))) == [15, 15] and not c.run(Q.Scan(Q.Eq("n", 3)))


@pytest.mark.parametrize("most", [200, 2])
def test_lanes_keep_all_documents_and_types(spark, folder, most):
    """Fields of several types, odd names and names that differ in case, missing and null values, in all stages of a collection."""
    c = Collection.open(spark, f"{folder}/c", Config(learn=False, lanes=most))
    nan = float("nan")
    c.put_frame(spark.sql("SELECT string(id) AS k, id AS a, string(id) AS A2, IF(id % 3 = 0, NULL, id / 2) AS `x.y`, array(id) AS l, id % 2 = 0 AS b FROM range(10)"), "k")
    queries = [Q.Eq("a", 3), Q.Gt("a", 3), Q.Not(Q.Lt("a", 3)), Q.Eq("a", "3"), Q.Eq("A", 1.0), Q.Exists("A"), Q.Not(Q.Exists("x.y")), Q.Eq("a", None),
               Q.Gt("x.y", 0.5), Q.Range("x.y", 0.0, 2.0), Q.Eq("b", True), Q.Exists("l"), Q.Eq("l", [3]), Q.Not(Q.Eq("é", "ü")), Q.Or(Q.Eq("A2", "7"), Q.Gt("é", "a"))]
    scans = [Q.Scan(sort=(Q.SortField(f, d),), limit=7, project=p) for f, d, p in (("a", False, ("x.y", "a")), ("x.y", True, None), ("é", False, ("a", "l")))]

    def check(n):
        def kept(rows, fields):  # of each filter, in one job
            tests = [F.coalesce(compile_filter(f, fields), F.lit(False)).alias(f"f{i}") for i, f in enumerate(queries)]
            return sorted(map(tuple, rows.select("_id", *tests).collect()))

        show = lambda df: [(d.id, sorted((k, v.canonical()) for k, v in d.fields.items())) for d in map(Document.of, df.collect())]
        rows, _, fields = c._source(Q.Scan(), None)
        want = kept(c.frame(), TaggedFields())
        assert len(want) == n and kept(rows, fields) == want
        for q in scans:
            assert show(c.scan(q)) == show(scan(c.frame(), q, TaggedFields())), q

    before = {d.id: d.fields for d in map(Document.of, c.frame().collect())}
    assert before["4"]["x.y"].raw == 2.0 and "x.y" not in before["3"] and set(before["3"]) == {"a", "A2", "l", "b"}
    check(10)
    c.put_batch([("3", {"a": "three", "A": 1.0, "é": "ü"}), ("11", {"a": None, "x.y": nan}), ("12", {"A": 2, "x.y": -0.0, "l": b"\x00"}), ("13", {})])
    c.delete("5")
    check(12)
    c.flush()
    c.merge_segments(c.segments)
    check(12)
    c.put_frame(spark.sql("SELECT string(id) AS k, id AS a, string(id) AS `é` FROM range(20, 30)"), "k")
    c.delete_frame(spark.sql("SELECT string(id) FROM range(25, 27)"))
    check(20)
    c = Collection.open(spark, f"{folder}/c", Config(learn=False, lanes=most))
    c.verify()
    c.merge_segments(c.segments)
    check(20)
    c.verify()
    assert c.get("4").fields == before["4"] and c.segments[0].live == 20


def test_nested_columns_are_values(spark, folder):
    """Arrays, structs and maps of a DataFrame equal the same values written one by one."""
    c = Collection.open(spark, f"{folder}/c", Config(learn=False))
    made = "array(1, NULL) AS a, struct('q\"\\\\' || char(31) AS z, 1e16D AS b, CAST(NULL AS INT) AS c) AS s, map('k', array(0.5D, 1e-5D, 12345678.9D, -0.0D)) AS m, array(X'00FF') AS y"
    c.put_frame(spark.sql(f"SELECT 'x' AS id, {made}"), "id")
    values = {"a": [1, None], "s": {"z": 'q"\\\x1f', "b": 1e16}, "m": {"k": [0.5, 1e-5, 12345678.9, -0.0]}, "y": [b"\x00\xff"]}
    c.put(values, "y")
    x, y = c.get("x"), c.get("y")
    assert {n: v.canonical() for n, v in x.fields.items()} == {n: v.canonical() for n, v in y.fields.items()}
    for name, value in values.items():
        assert len(c.run(Q.Scan(Q.Eq(name, value)))) == 2, name
    assert x.get("m") == values["m"] and x.get("s") == values["s"]
