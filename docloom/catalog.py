"""The driver's queries over the Parquet tables, each beside its SQL.

``QUERIES`` maps names to (spark, sf_dir) -> DataFrame; ``ORACLE_SQL`` has the
same result in DuckDB's SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import DocloomError
from .functions.fields import TaggedFields, TypedFields
from .functions.values import Tag, decode, encode, lift, u64
from .operators import compaction as C
from .operators import versions as V
from .operators.ordering import ranked
from .operators.traverse import HOP, traverse
from .plans import query as Q
from .plans.compiler import compile_filter, scan, sort_columns
from .sources.collection import Collection, Config, Snapshot
from .sources.database import Database
from .sources.files import Scratch
from .stats import QueryPattern, QueryStats, pattern_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scan(name: str, table: str, id: str, q: Q.Scan, sql: str) -> None:
    """Registers a scan of one table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _t(spark, sf_dir, table)
        return scan(df, q, TypedFields(df, id=id))

    run.__name__ = name
    query(sql)(run)


# -- point lookups -----------------------------------------------------------------

_ORDER = ("o_custkey", "o_orderstatus", "o_totalprice")
_scan("get_by_id", "orders", "o_orderkey", Q.Scan(Q.Eq("_id", 7), project=_ORDER), "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7")
_scan("get_missing", "orders", "o_orderkey", Q.Scan(Q.Eq("_id", -1), project=_ORDER), "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = -1")


@query("SELECT count(*) > 0 AS found FROM customer WHERE c_custkey = 11")
def contains_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "customer")
    return df.where(compile_filter(Q.Eq("_id", 11), TypedFields(df, id="c_custkey"))).agg((F.count("*") > 0).alias("found"))


# -- filters -------------------------------------------------------------------------

_LINE = "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem"
_LINE_FIELDS = ("l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
_FILTERS = {
    "filter_eq": (Q.Eq("l_returnflag", "R"), "l_returnflag = 'R'"),
    "filter_gt": (Q.Gt("l_quantity", 45.0), "l_quantity > 45"),
    "filter_lt": (Q.Lt("l_discount", 0.02), "l_discount < 0.02"),
    "filter_range": (Q.Range("l_quantity", 10.0, 20.0), "l_quantity >= 10 AND l_quantity < 20"),
    "filter_and": (Q.And(Q.Eq("l_returnflag", "A"), Q.Gt("l_quantity", 30.0)), "l_returnflag = 'A' AND l_quantity > 30"),
    "filter_or": (Q.Or(Q.Lt("l_quantity", 3.0), Q.Gt("l_quantity", 48.0)), "l_quantity < 3 OR l_quantity > 48"),
    "filter_not": (Q.Not(Q.Eq("l_linestatus", "O")), "NOT l_linestatus = 'O'"),
    "filter_nested": (
        Q.And(Q.Or(Q.Eq("l_returnflag", "R"), Q.Not(Q.Gt("l_tax", 0.02))), Q.Not(Q.And(Q.Lt("l_quantity", 25.0), Q.Eq("l_linenumber", 1)))),
        "(l_returnflag = 'R' OR NOT l_tax > 0.02) AND NOT (l_quantity < 25 AND l_linenumber = 1)",
    ),
}
for _name, (_f, _where) in _FILTERS.items():
    _scan(_name, "lineitem", "l_orderkey", Q.Scan(_f, project=_LINE_FIELDS), f"{_LINE} WHERE {_where}")

_scan("scan_all", "nation", "n_nationkey", Q.Scan(), "SELECT * FROM nation")
_scan("filter_empty_and", "region", "r_regionkey", Q.Scan(Q.And()), "SELECT * FROM region WHERE true")
_scan("filter_empty_or", "region", "r_regionkey", Q.Scan(Q.Or()), "SELECT * FROM region WHERE false")
# types are strict: an integer never equals a double, an unsigned never a signed
_scan("filter_eq_type_mismatch", "part", "p_partkey", Q.Scan(Q.Eq("p_retailprice", 901)), "SELECT * FROM part WHERE false")
_scan("filter_unsigned_mismatch", "part", "p_partkey", Q.Scan(Q.Or(Q.Eq("p_size", u64(5)), Q.Gt("p_size", u64(1)))), "SELECT * FROM part WHERE false")
# ids can be equal but have no order
_scan("filter_id_gt_is_false", "part", "p_partkey", Q.Scan(Q.Gt("_id", 5)), "SELECT * FROM part WHERE false")

_DOCS_SQL = """SELECT 'customer:' || c_custkey AS doc_id, c_custkey, c_name, c_acctbal, CAST(NULL AS BIGINT) AS o_custkey, CAST(NULL AS DOUBLE) AS o_totalprice, CAST(NULL AS VARCHAR) AS o_orderstatus FROM customer
UNION ALL SELECT 'order:' || o_orderkey, NULL, NULL, NULL, o_custkey, o_totalprice, o_orderstatus FROM orders"""


def documents_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, TypedFields]:
    """Customers and orders as one collection whose documents differ in their fields."""
    customers = _t(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("doc_id"), "c_custkey", "c_name", "c_acctbal")
    orders = _t(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("doc_id"), "o_custkey", "o_totalprice", "o_orderstatus")
    df = customers.unionByName(orders, allowMissingColumns=True)
    return df, TypedFields(df, id="doc_id")


def _mixed(name: str, f: Q.Filter, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, fields = documents_of(spark, sf_dir)
        return scan(df, Q.Scan(f), fields)

    run.__name__ = name
    query(f"SELECT * FROM ({_DOCS_SQL}) d WHERE {where}")(run)


_mixed("filter_exists", Q.Exists("o_totalprice"), "o_totalprice IS NOT NULL")
_mixed("filter_not_exists", Q.Not(Q.Exists("o_totalprice")), "o_totalprice IS NULL")
_mixed("filter_not_missing", Q.Not(Q.Gt("c_acctbal", 5000.0)), "NOT coalesce(c_acctbal > 5000, false)")
_mixed("filter_not_in_or", Q.Or(Q.Not(Q.Lt("o_totalprice", 200000.0)), Q.Eq("c_custkey", 3)), "NOT coalesce(o_totalprice < 200000, false) OR coalesce(c_custkey = 3, false)")
_mixed("filter_unknown_field", Q.Not(Q.Eq("no_such_field", 1)), "true")

# -- NaN, null and types in tagged documents --------------------------------------------

_VALUES = [
    ("a", {"x": 5}), ("b", {"x": u64(5)}), ("c", {"x": 5.0}), ("d", {"x": None}), ("e", {}), ("f", {"x": float("nan")}),
    ("g", {"x": "5"}), ("h", {"x": True}), ("i", {"x": -1}), ("j", {"x": [1, 2]}), ("k", {"x": {"y": 1}}), ("l", {"x": b"\x05"}),
    ("m", {"x": 7.5}), ("n", {"x": -0.0}), ("o", {"x": 0.0}), ("p", {"x": u64(2**64 - 1)}),
]


def tagged(spark: SparkSession) -> DataFrame:
    """One field with values of all types, missing in one document."""
    rows = [(id_, 1, False, {k: encode(v) for k, v in fields.items()}) for id_, fields in _VALUES]
    from .sources.collection import SCHEMA

    return spark.createDataFrame(rows, SCHEMA)


_TAGGED = {
    "tagged_eq_integer": (Q.Eq("x", 5), "a"),
    "tagged_eq_unsigned": (Q.Eq("x", u64(5)), "b"),
    "tagged_eq_float": (Q.Eq("x", 5.0), "c"),
    "tagged_eq_null": (Q.Eq("x", None), "d"),
    "tagged_eq_nan": (Q.Eq("x", float("nan")), ""),
    "tagged_eq_array": (Q.Eq("x", [1, 2]), "j"),
    "tagged_eq_document": (Q.Eq("x", {"y": 1}), "k"),
    "tagged_eq_zero": (Q.Eq("x", 0.0), "no"),
    "tagged_exists": (Q.Exists("x"), "abcdfghijklmnop"),
    "tagged_gt_float": (Q.Gt("x", 5.0), "m"),
    "tagged_not_gt": (Q.Not(Q.Gt("x", 0)), "bcdefghijklmnop"),
    "tagged_range": (Q.Range("x", -1, 6), "ai"),
    "tagged_lt_unsigned": (Q.Lt("x", u64(6)), "b"),
}


def _tagged(name: str, f: Q.Filter, ids: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scan(tagged(spark), Q.Scan(f), TaggedFields()).select(F.col("_id").alias("doc_id"))

    run.__name__ = name
    rows = ", ".join(f"('{c}')" for c in ids)
    query(f"SELECT doc_id FROM (VALUES {rows}) t(doc_id)" if ids else "SELECT 'x' AS doc_id WHERE false")(run)


for _name, (_f, _ids) in _TAGGED.items():
    _tagged(_name, _f, _ids)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i + 1}, '{c}')" for i, c in enumerate("dhiabpnocmfgljke")) + ") t(place, doc_id)")
def comparable_encoding_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All values in the one total order: by type, then by value; the missing one last."""
    rows = tagged(spark).orderBy(*sort_columns((Q.SortField("x"),), TaggedFields())).collect()  # the literal rows above
    return spark.createDataFrame([(i + 1, r["_id"]) for i, r in enumerate(rows)], "place int, doc_id string")


# -- project, sort, limit -----------------------------------------------------------------

_scan("project_fields", "customer", "c_custkey", Q.Scan(project=("c_name", "c_acctbal")), "SELECT c_custkey, c_name, c_acctbal FROM customer")
_scan("project_missing_field", "customer", "c_custkey", Q.Scan(project=("c_name", "nothing", "_id")), "SELECT c_custkey, c_name FROM customer")


def _sorted(name: str, sort: tuple[Q.SortField, ...], sql: str, mixed: bool = False, keep: str = "s_suppkey") -> None:
    """Registers a sort; rows carry their place, as results are compared without order."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if mixed:
            df, fields = documents_of(spark, sf_dir)
        else:
            df = _t(spark, sf_dir, "supplier")
            fields = TypedFields(df, id="s_suppkey")
        return ranked(df, sort_columns(sort, fields)).select(keep, "place")

    run.__name__ = name
    query(sql)(run)


_sorted("sort_asc", (Q.SortField("s_acctbal"),), "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS place FROM supplier")
_sorted("sort_desc", (Q.SortField("s_acctbal", True),), "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS place FROM supplier")
_sorted(
    "sort_multi_mixed", (Q.SortField("s_nationkey"), Q.SortField("s_acctbal", True)),
    "SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey, s_acctbal DESC, s_suppkey) AS place FROM supplier",
)
_sorted("sort_missing_asc", (Q.SortField("c_acctbal"),), f"SELECT doc_id, row_number() OVER (ORDER BY c_acctbal ASC NULLS LAST, doc_id) AS place FROM ({_DOCS_SQL}) d", True, "doc_id")
_sorted("sort_missing_desc", (Q.SortField("c_acctbal", True),), f"SELECT doc_id, row_number() OVER (ORDER BY c_acctbal DESC NULLS FIRST, doc_id) AS place FROM ({_DOCS_SQL}) d", True, "doc_id")

_scan("limit_default_order", "part", "p_partkey", Q.Scan(limit=10), "SELECT * FROM part ORDER BY p_partkey LIMIT 10")
_scan("limit_zero", "part", "p_partkey", Q.Scan(limit=0), "SELECT * FROM part LIMIT 0")
_BRAND = "Brand#23"
_scan(
    "flagship_catalog", "part", "p_partkey", Q.Scan(Q.Eq("p_brand", _BRAND), sort=(Q.SortField("p_retailprice"),)),
    f"SELECT * FROM part WHERE p_brand = '{_BRAND}' ORDER BY p_retailprice, p_partkey",
)
_scan(
    "compound_filter_topk", "part", "p_partkey",
    Q.Scan(Q.And(Q.Gt("p_retailprice", 950.0), Q.Gt("p_size", 30)), sort=(Q.SortField("p_size", True), Q.SortField("p_retailprice", True)), limit=20),
    "SELECT * FROM part WHERE p_retailprice > 950 AND p_size > 30 ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 20",
)
_scan(
    "filter_sort_project_limit", "part", "p_partkey",
    Q.Scan(Q.Eq("p_brand", _BRAND), sort=(Q.SortField("p_retailprice"),), project=("p_name", "p_retailprice"), limit=10),
    f"SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_brand = '{_BRAND}' ORDER BY p_retailprice, p_partkey LIMIT 10",
)

_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax"]


@query(f"SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, {', '.join(_LINE_ORDER)} LIMIT 20")
def topk_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _t(spark, sf_dir, "lineitem")  # it has no key, so all columns break ties
    q = Q.Scan(sort=(Q.SortField("l_extendedprice", True), *map(Q.SortField, _LINE_ORDER)), limit=20)
    return scan(df, q, TypedFields(df, id="l_orderkey")).select("l_orderkey", "l_linenumber", "l_extendedprice")


# -- versions: events are a log of users, an error is a tombstone ------------------------------

_LOG = {"id": "user_id", "version": ["ts", "event_id"]}
_EVENT = ("user_id", "event_id", "event_type", "value")
_EVENT_SQL = "user_id, event_id, event_type, value"
_BOUNDS = ("2024-01-10 00:00:00", "2024-01-20 00:00:00")
_NEWEST = "row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)"


def _bound(text: str):
    return F.lit(text).cast("timestamp_ntz")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").withColumn("_deleted", F.col("event_type") == "error")


def _latest_sql(where: str = "true") -> str:
    return f"SELECT {_EVENT_SQL} FROM (SELECT *, {_NEWEST} AS r FROM events WHERE {where}) e WHERE r = 1 AND event_type <> 'error'"


@query(_latest_sql())
def mvcc_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.latest(_log(spark, sf_dir), **_LOG).select(*_EVENT)


@query(_latest_sql(f"ts <= TIMESTAMP '{_BOUNDS[0]}'"))
def mvcc_snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.latest(_log(spark, sf_dir), _bound(_BOUNDS[0]), **_LOG).select(*_EVENT)


@query(_latest_sql(f"ts <= TIMESTAMP '{_BOUNDS[1]}' AND user_id = 5"))
def mvcc_snapshot_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.latest(_log(spark, sf_dir).where("user_id = 5"), _bound(_BOUNDS[1]), **_LOG).select(*_EVENT)


@query(" UNION ALL ".join(f"SELECT {i} AS snapshot, * FROM ({_latest_sql(f'''ts <= TIMESTAMP '{b}' ''')}) s{i}" for i, b in enumerate(_BOUNDS)))
def mvcc_two_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [V.latest(_log(spark, sf_dir), _bound(b), **_LOG).select(F.lit(i).alias("snapshot"), *_EVENT) for i, b in enumerate(_BOUNDS)]
    return parts[0].unionByName(parts[1])


@query(f"SELECT user_id FROM (SELECT *, {_NEWEST} AS r FROM events) e WHERE r = 1 AND event_type = 'error'")
def mvcc_delete_hides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that have versions but no live one."""
    log = _log(spark, sf_dir)
    return log.select("user_id").distinct().join(V.latest(log, **_LOG).select("user_id"), "user_id", "left_anti")


@query(f"SELECT user_id, json_extract_string(props, '$.k')::BIGINT AS k FROM (SELECT *, {_NEWEST} AS r FROM events) e WHERE r = 1 AND event_type <> 'error'")
def upsert_replaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new version replaces all fields of the one before."""
    return V.latest(_log(spark, sf_dir), **_LOG).select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(f"SELECT {_EVENT_SQL} FROM (SELECT *, {_NEWEST} AS r FROM events) e WHERE r = 1")
def compaction_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merge(_log(spark, sf_dir), [], False, **_LOG).select(*_EVENT)


@query(
    "SELECT DISTINCT user_id, event_id, event_type, value FROM ("
    + " UNION ALL ".join(f"SELECT {_EVENT_SQL} FROM (SELECT *, {_NEWEST} AS r FROM events WHERE {w}) e WHERE r = 1" for w in ("true", *(f"ts <= TIMESTAMP '{b}'" for b in _BOUNDS)))
    + ") u"
)
def compaction_retain_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merge(_log(spark, sf_dir), [_bound(b) for b in _BOUNDS], True, **_LOG).select(*_EVENT)


@query(_latest_sql())
def tombstone_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merge(_log(spark, sf_dir), [], True, **_LOG).select(*_EVENT)


@query(f"SELECT user_id, event_id, value * 2 AS doubled FROM (SELECT *, {_NEWEST} AS r FROM events) e WHERE r = 1 AND event_type <> 'view'")
def compaction_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compaction filter that drops some documents and rewrites the others."""
    drop_views = lambda df: df.where("event_type <> 'view'").withColumn("doubled", F.col("value") * 2)
    return C.merge(_log(spark, sf_dir), [], False, drop_views, **_LOG).select("user_id", "event_id", "doubled")


# -- traversal ---------------------------------------------------------------------------------


def _walk(name: str, q: Q.Traverse, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, fields = documents_of(spark, sf_dir)
        return traverse(df, q, fields).select("doc_id", F.col(HOP).alias("hop"))

    run.__name__ = name
    query(sql)(run)


_walk(
    "traverse_simple", Q.Traverse(Q.Gt("o_totalprice", 400000.0), "o_custkey", "c_custkey", 1),
    "SELECT 'customer:' || c_custkey AS doc_id, 1 AS hop FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 400000)",
)
_walk(
    "traverse_non_unique", Q.Traverse(Q.Lt("c_acctbal", 0.0), "c_custkey", "o_custkey", 1),
    "SELECT 'order:' || o_orderkey AS doc_id, 1 AS hop FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE o.o_custkey = c.c_custkey AND c_acctbal < 0)",
)
_NONE = "SELECT 'x' AS doc_id, 1 AS hop WHERE false"
_walk("traverse_depth0", Q.Traverse(None, "o_custkey", "c_custkey", 0), _NONE)
_walk("traverse_no_match", Q.Traverse(Q.Eq("c_custkey", -5), "c_custkey", "o_custkey", 3), _NONE)
_walk("traverse_type_mismatch", Q.Traverse(None, "o_totalprice", "c_custkey", 2), _NONE)
_walk("traverse_self_edge", Q.Traverse(Q.Eq("o_orderstatus", "P"), "doc_id", "doc_id", 4), "SELECT 'order:' || o_orderkey AS doc_id, 1 AS hop FROM orders WHERE o_orderstatus = 'P'")


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and orders as one collection with one edge, parent -> doc_id."""
    levels = (("region", "r_regionkey", None, None), ("nation", "n_nationkey", "region", "n_regionkey"), ("customer", "c_custkey", "nation", "c_nationkey"), ("orders", "o_orderkey", "customer", "o_custkey"))
    parts = []
    for table, key, above, up in levels:
        name = table.rstrip("s")
        parent = F.concat(F.lit(f"{above}:"), up) if above else F.lit(None).cast("string")
        parts.append(_t(spark, sf_dir, table).select(F.concat(F.lit(f"{name}:"), key).alias("doc_id"), parent.alias("parent")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""
WITH s AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderkey < 4)
SELECT 'customer:' || c AS doc_id, 1 AS hop FROM s
UNION ALL SELECT DISTINCT 'nation:' || c_nationkey, 2 FROM customer JOIN s ON c_custkey = c
UNION ALL SELECT DISTINCT 'region:' || n_regionkey, 3 FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN s ON c_custkey = c""")
def traverse_up_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = hierarchy(spark, sf_dir)
    start = Q.Or(*(Q.Eq("_id", f"order:{i}") for i in range(4)))
    return traverse(df, Q.Traverse(start, "parent", "_id", 3), TypedFields(df, id="doc_id")).select("doc_id", F.col(HOP).alias("hop"))


@query("""
SELECT 'nation:' || n_nationkey AS doc_id, 1 AS hop FROM nation WHERE n_regionkey = 2
UNION ALL SELECT 'customer:' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2""")
def traverse_down_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = hierarchy(spark, sf_dir)
    return traverse(df, Q.Traverse(Q.Eq("_id", "region:2"), "_id", "parent", 2), TypedFields(df, id="doc_id")).select("doc_id", F.col(HOP).alias("hop"))


@query("""
WITH RECURSIVE r(k, hop) AS (
  SELECT DISTINCT p_partkey // 10, 1 FROM part WHERE p_size = 7
  UNION SELECT k // 10, hop + 1 FROM r WHERE hop < 10)
SELECT k AS p_partkey, min(hop)::INTEGER AS hop FROM r GROUP BY k""")
def traverse_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part n lies under part n / 10, and part 0 under itself."""
    df = _t(spark, sf_dir, "part").withColumn("parent", F.expr("p_partkey div 10"))
    found = traverse(df, Q.Traverse(Q.Eq("p_size", 7), "parent", "_id", 10), TypedFields(df, id="p_partkey"))
    return found.select("p_partkey", F.col(HOP).alias("hop"))


# -- collections, indexes and catalog --------------------------------------------------------------


def _parts(spark: SparkSession, sf_dir: str, **settings) -> Collection:
    """The parts as a durable collection in the shared folder."""
    c = Collection.open(spark, f"{Scratch(spark, 'parts').folder.path}/parts", Config(**settings))
    c.put_frame(_t(spark, sf_dir, "part"), "p_partkey")
    return c


def _untag(df: DataFrame) -> DataFrame:
    x = F.col("fields")
    return df.select(F.col("_id").cast("long").alias("p_partkey"), x["p_brand"]["s"].alias("p_brand"), x["p_size"]["i"].alias("p_size"), x["p_retailprice"]["d"].alias("p_retailprice"))


_PART_SQL = "SELECT p_partkey, p_brand, p_size::BIGINT AS p_size, p_retailprice FROM part"


@query(_PART_SQL)
def collection_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _untag(_parts(spark, sf_dir).frame())


@query(f"{_PART_SQL} ORDER BY p_retailprice, p_partkey::VARCHAR LIMIT 50")
def index_sorted_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _parts(spark, sf_dir)
    c.build_index(["p_retailprice"])
    return _untag(c.scan(Q.Scan(sort=(Q.SortField("p_retailprice"),), limit=50)))


@query(f"{_PART_SQL} ORDER BY p_retailprice DESC, p_partkey::VARCHAR LIMIT 25")
def index_desc_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _parts(spark, sf_dir)
    c.build_index(["p_retailprice"])
    return _untag(c.scan(Q.Scan(sort=(Q.SortField("p_retailprice", True),), limit=25)))


@query(f"{_PART_SQL} WHERE p_size >= 10 AND p_size < 15")
def index_filter_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _parts(spark, sf_dir)
    c.build_index(["p_size"])
    return _untag(c.scan(Q.Scan(Q.Range("p_size", 10, 15))))


@query("SELECT p_partkey, p_brand, p_size, p_retailprice FROM (SELECT p_partkey, p_brand, (CASE WHEN p_brand = 'Brand#23' THEN p_size + 100 ELSE p_size END)::BIGINT AS p_size, p_retailprice FROM part) t WHERE p_size > 45")
def index_stale_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents change after the index was built; the index finds them where they are now."""
    c = _parts(spark, sf_dir)
    c.build_index(["p_size"])
    changed = _t(spark, sf_dir, "part").where("p_brand = 'Brand#23'").withColumn("p_size", F.col("p_size") + 100)
    c.put_frame(changed, "p_partkey")
    return _untag(c.scan(Q.Scan(Q.Gt("p_size", 45))))


@query(f"{_PART_SQL} WHERE p_size < 5 OR p_size > 45")
def index_partial_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two partial indexes on one field merge into one that claims just both ranges."""
    c = _parts(spark, sf_dir)
    low, high = Q.Lt("p_size", 5), Q.Gt("p_size", 45)
    c.build_index(["p_size"], low)
    c.build_index(["p_size"], high)
    c.maintain_indexes()
    return _untag(c.scan(Q.Scan(Q.Or(low, high), sort=(Q.SortField("p_size"),))))


@query("SELECT p_partkey, p_brand, p_size::BIGINT AS p_size, p_retailprice * 2 AS p_retailprice FROM part WHERE p_size <= 25")
def compaction_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upserts and deletes over several segments, merged into one."""
    c, part = _parts(spark, sf_dir), _t(spark, sf_dir, "part")
    c.put_frame(part.withColumn("p_retailprice", F.col("p_retailprice") * 2), "p_partkey")
    c.delete_frame(part.where("p_size > 25").select("p_partkey"))
    c.merge_segments(c.segments)
    return _untag(c.frame())


@query(f"{_PART_SQL} WHERE p_partkey::VARCHAR BETWEEN '120' AND '19'")
def key_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a closed range of ids, in the order of text."""
    return _untag(_parts(spark, sf_dir).range("120", "19"))


@query("SELECT r_regionkey AS id, CASE WHEN r_regionkey = 3 THEN 'renamed' ELSE r_name END AS name FROM region WHERE r_regionkey <> 2 AND r_regionkey < 4")
def put_delete_execute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single writes and deletes, read back by execute from buffer and segments."""
    c = Collection.open(spark, f"{Scratch(spark, 'put').folder.path}/regions")
    for r in _t(spark, sf_dir, "region").collect():  # five rows
        c.put({"key": r["r_regionkey"], "name": r["r_name"]}, f"{r['r_regionkey']}")
    c.flush()
    c.put({"key": 3, "name": "renamed"}, "3")
    c.delete("2")
    found = c.execute(Q.Scan(Q.Not(Q.Gt("key", 3))))
    return found.select(F.col("fields")["key"]["i"].cast("int").alias("id"), F.col("fields")["name"]["s"].alias("name"))


def _changed_parts(spark: SparkSession, sf_dir: str) -> tuple[Collection, Snapshot]:
    """The parts, a snapshot of them, and changes and deletes made after it."""
    c, part = _parts(spark, sf_dir), _t(spark, sf_dir, "part")
    before = c.snapshot()
    c.put_frame(part.where("p_size < 10").withColumn("p_retailprice", F.lit(0.0)), "p_partkey")
    c.delete_frame(part.where("p_size > 40").select("p_partkey"))
    return c, before


@query(f"{_PART_SQL} WHERE p_size < 10 OR p_size > 40")
def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot sees what was there, whatever is written and merged after it."""
    c, before = _changed_parts(spark, sf_dir)
    c.merge_segments(c.segments)
    return _untag(before.scan(Q.Scan(Q.Or(Q.Lt("p_size", 10), Q.Gt("p_size", 40)))))


@query(f"{_PART_SQL} WHERE p_partkey = 7")
def snapshot_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, before = _changed_parts(spark, sf_dir)
    c.delete("7")
    d = before.get("7")
    return spark.createDataFrame([(int(d.id), d.get("p_brand"), d.get("p_size"), d.get("p_retailprice"))], "p_partkey long, p_brand string, p_size long, p_retailprice double")


@query("SELECT p_partkey FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size > 48)")
def snapshot_traverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hop from parts that are deleted by now, over the snapshot."""
    _, before = _changed_parts(spark, sf_dir)
    found = before.traverse(Q.Traverse(Q.Gt("p_size", 48), "p_brand", "p_brand", 1))
    return found.select(F.col("_id").cast("long").alias("p_partkey"))


@query("SELECT r_regionkey AS id, r_name AS name FROM region WHERE r_regionkey < 3")
def log_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that no segment holds yet survive; of a damaged log its whole files before the damage do."""
    path = f"{Scratch(spark, 'log').folder.path}/regions"
    c = Collection.open(spark, path)
    for r in sorted(_t(spark, sf_dir, "region").collect()):  # five rows
        c.put({"key": r["r_regionkey"], "name": r["r_name"]}, f"{r['r_regionkey']}")
    c.files.delete(f"log/{3:012d}.json")
    c.files.create(f"log/{3:012d}.json", {"rows": "torn"})
    again = Collection.open(spark, path)
    x = F.col("fields")
    return again.frame().select(x["key"]["i"].cast("int").alias("id"), x["name"]["s"].alias("name"))


@query("SELECT p_brand, count(*)::BIGINT AS n, sum(p_size + 3)::BIGINT AS sizes, true AS merged FROM part GROUP BY p_brand")
def compaction_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over the same ids leave fewer segments, as each write may merge."""
    c = _parts(spark, sf_dir, inline_compaction=True)
    for n in (1, 2, 3):
        c.put_frame(_t(spark, sf_dir, "part").withColumn("p_size", F.col("p_size") + n), "p_partkey")
    found = _untag(c.frame()).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("sizes"))
    return found.withColumn("merged", F.lit(c.segment_count < 4))


@query("SELECT * FROM (VALUES ('EngineError'), ('FieldNotFound'), ('HashMismatch'), ('SegmentError'), ('UnknownTag')) t(name)")
def errors_raised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each kind of damage or misuse raises."""
    c = _parts(spark, sf_dir)
    first = c.segments[0]

    def rehashed() -> None:
        other = f"{c.files.path}/segment/other"
        spark.read.parquet(f"{c.files.path}/{first.name}").withColumn("_hash", F.lit("0")).write.parquet(other)
        c._segments = [replace(first, name="segment/other")]
        c.verify()

    def missing() -> None:
        c._segments = [replace(first, name="segment/none")]
        c.frame()

    def vacuumed() -> None:
        with c.snapshot():
            c.vacuum()

    cases = (lambda: c.get("1").extract("nothing"), lambda: decode({"tag": 99}), vacuumed, rehashed, missing)
    names = []
    for case in cases:
        try:
            case()
        except DocloomError as e:
            names.append((type(e).__name__,))
    return spark.createDataFrame(names, "name string")


@query("SELECT * FROM (VALUES ('alpha'), ('beta'), ('system')) t(name)")
def collections_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark, f"{Scratch(spark, 'db').folder.path}/db")
    for name in ("beta", "alpha", "gone"):
        db.collection(name)
    db.drop_collection("gone")
    return spark.createDataFrame([(n,) for n in db.list_collections()], "name string")


@query("SELECT * FROM (VALUES ('index', 'parts', 'p_brand,p_size'), ('index', 'parts', 'p_retailprice')) t(type, collection, fields)")
def system_index_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark, f"{Scratch(spark, 'db').folder.path}/db")

    def fill(c: Collection) -> None:
        c.put_frame(_t(spark, sf_dir, "part"), "p_partkey")
        c.build_index(["p_retailprice"])
        c.build_index(["p_brand", "p_size"])

    db.with_collection("parts", fill)
    x = F.col("fields")
    return db.system.frame().select(*(x[n]["s"].alias(n) for n in ("type", "collection", "fields")))


# -- statistics and policies --------------------------------------------------------------------------


def _workload() -> QueryStats:
    stats = QueryStats()
    age = Q.Scan(Q.Gt("age", 15))
    for q, scanned, returned in (*[(age, 20, 4)] * 5, (Q.Scan(Q.Lt("age", 3), sort=(Q.SortField("name"),)), 100, 1), *[(Q.Get("x"), 1, 1)] * 3, (Q.Traverse(None, "a", "b", 2), 0, 7)):
        stats.record(pattern_of(q), 0.0, scanned, returned)
    return stats


def _stat_rows(spark: SparkSession, found: list) -> DataFrame:
    rows = [(p.kind, ",".join(p.filter_fields), ",".join(p.sort_fields), s.count, s.scanned, s.returned, float(s.selectivity)) for p, s in found]
    return spark.createDataFrame(rows, "kind string, filter_fields string, sort_fields string, count long, scanned long, returned long, selectivity double")


_STATS = ["('scan', 'age', '', 5, 100, 20, 0.2)", "('scan', 'age', 'name', 1, 100, 1, 0.01)", "('get', '', '', 3, 3, 3, 1.0)", "('traverse', '', '', 1, 0, 7, 1.0)"]


def _stats_sql(rows: list[str]) -> str:
    return f"SELECT kind, filter_fields, sort_fields, count::BIGINT AS count, scanned::BIGINT AS scanned, returned::BIGINT AS returned, selectivity::DOUBLE AS selectivity FROM (VALUES {', '.join(rows)}) t(kind, filter_fields, sort_fields, count, scanned, returned, selectivity)"


@query(_stats_sql(_STATS))
def stats_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stat_rows(spark, _workload().all())


@query(_stats_sql(_STATS[:1]))
def stats_low_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stat_rows(spark, _workload().low_selectivity(0.5, 2))


@query(_stats_sql([_STATS[0], _STATS[2]]))
def stats_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stat_rows(spark, _workload().top_by_count(2))


@query("SELECT size::BIGINT AS size, greatest(0, floor(ln(size / 1000.0) / ln(2) + 1e-9))::INTEGER AS level FROM (VALUES (500), (1000), (1999), (2000), (4000), (8000)) t(size)")
def ucs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = C.UnifiedPolicy(0, 1000)
    return spark.createDataFrame([(n, policy.level(n)) for n in (500, 1000, 1999, 2000, 4000, 8000)], "size long, level int")


@query("SELECT * FROM (VALUES ('a', 1), ('b', 1), ('c', 1)) t(name, level)")
def ucs_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of one level, the largest group of segments whose ranges hang together."""
    ranges = {"a": ("00", "40"), "b": ("30", "60"), "c": ("60", "70"), "d": ("80", "90"), "e": ("85", "95")}
    pick = C.UnifiedPolicy(0, 1000).pick([C.Segment(n, low, high, 900) for n, (low, high) in ranges.items()])
    return spark.createDataFrame([(s.name, pick.level) for s in pick.segments], "name string, level int")


@query("SELECT reads::BIGINT AS reads, trunc(8 - 16 * reads / 100.0)::INTEGER AS w FROM (VALUES (0), (25), (40), (50), (65), (100)) t(reads)")
def adaptive_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for reads in (0, 25, 40, 50, 65, 100):
        a = C.AdaptiveScaling(clock=lambda: 0.0)
        a.read(reads)
        a.write(100 - reads)
        rows.append((reads, a.adjust()))
    return spark.createDataFrame(rows, "reads long, w int")


# -- extensions: what DataFrames add to a collection ------------------------------------------------------


@query("SELECT p_brand, count(*)::BIGINT AS n, sum(p_size)::BIGINT AS sizes FROM part GROUP BY p_brand")
def extension_sql_over_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over a collection, through a view."""
    _untag(_parts(spark, sf_dir).frame()).createOrReplaceTempView("docloom_parts")
    return spark.sql("SELECT p_brand, count(*) AS n, sum(p_size) AS sizes FROM docloom_parts GROUP BY p_brand")


@query("SELECT n_name, count(*)::BIGINT AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name")
def extension_cross_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered scan joined with another collection."""
    df = _t(spark, sf_dir, "customer")
    customers = scan(df, Q.Scan(Q.Gt("c_acctbal", 0.0)), TypedFields(df, id="c_custkey"))
    nations = _t(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return customers.join(nations, "c_nationkey").groupBy("n_name").agg(F.count("*").alias("customers"))


__all__ = ["QUERIES", "ORACLE_SQL", "QueryPattern", "Tag", "lift"]
