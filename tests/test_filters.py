from __future__ import annotations

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from docloom.functions.fields import TaggedFields, TypedFields
from docloom.functions.values import ORDERED, Tag, Value, decode, encode, lift, u64
from docloom.plans import query as Q
from docloom.plans.compiler import compile_filter, scan
from docloom.sources.collection import SCHEMA

MISSING = object()


def holds(f: Q.Filter, doc: dict) -> bool:
    """What a filter means, over one document of lifted values."""
    if isinstance(f, Q.And):
        return all(holds(p, doc) for p in f.parts)
    if isinstance(f, Q.Or):
        return any(holds(p, doc) for p in f.parts)
    if isinstance(f, Q.Not):
        return not holds(f.part, doc)
    v = doc.get(f.field, MISSING)
    if isinstance(f, Q.Exists):
        return v is not MISSING
    if v is MISSING or v.is_nan:
        return False
    literals = Q.literals(f)
    if any(x.tag != v.tag or x.is_nan for x in literals):
        return False
    if isinstance(f, Q.Eq):
        return v.raw == literals[0].raw
    if v.tag not in ORDERED:
        return False
    if isinstance(f, Q.Range):
        return literals[0].raw <= v.raw < literals[1].raw
    return v.raw > literals[0].raw if isinstance(f, Q.Gt) else v.raw < literals[0].raw


scalars = st.one_of(
    st.none(), st.booleans(), st.integers(-3, 3), st.integers(0, 3).map(u64), st.sampled_from([-1.5, 0.0, -0.0, 2.0, math.nan, math.inf]),
    st.sampled_from(["", "a", "é", "b"]), st.sampled_from([b"", b"\x7f", b"\xff"]), st.lists(st.integers(0, 2), max_size=2), st.fixed_dictionaries({"k": st.integers(0, 1)}),
)
names = st.sampled_from(["x", "y"])
leaf = st.one_of(
    st.builds(Q.Eq, names, scalars), st.builds(Q.Gt, names, scalars), st.builds(Q.Lt, names, scalars),
    st.builds(Q.Range, names, scalars, scalars), st.builds(Q.Exists, names),
)
filters = st.recursive(leaf, lambda f: st.one_of(st.lists(f, max_size=3).map(lambda p: Q.And(*p)), st.lists(f, max_size=3).map(lambda p: Q.Or(*p)), f.map(Q.Not)), max_leaves=5)
documents = st.lists(st.dictionaries(names, scalars), min_size=1, max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(documents, st.lists(filters, min_size=4, max_size=8))
def test_tagged_filters_mean_what_they_say(spark, docs, tests):
    rows = [(str(i), 1, False, {k: encode(v) for k, v in d.items()}) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    got = df.select("_id", *(F.coalesce(compile_filter(f, TaggedFields()), F.lit(False)).alias(f"f{i}") for i, f in enumerate(tests))).collect()
    for r in got:
        doc = {k: lift(v) for k, v in docs[int(r["_id"])].items()}
        assert [r[f"f{i}"] for i in range(len(tests))] == [holds(f, doc) for f in tests]


@settings(max_examples=100, deadline=None)
@given(scalars)
def test_values_survive_storage(x):
    v = lift(x)
    back = decode(encode(v))
    assert back.tag == v.tag and (back.canonical() == v.canonical())


def test_typed_backend(spark):
    df = spark.createDataFrame([(1, 5, 1.0, "a"), (2, None, math.nan, None), (3, 7, None, "b")], "id long, n int, d double, s string")
    fields = TypedFields(df, id="id")
    ids = lambda f: sorted(r["id"] for r in df.where(compile_filter(f, fields)).collect())
    assert ids(Q.Gt("n", 5)) == [3] and ids(Q.Not(Q.Gt("n", 5))) == [1, 2]
    assert ids(Q.Eq("n", 5.0)) == [] and ids(Q.Not(Q.Eq("n", 5.0))) == [1, 2, 3]
    assert ids(Q.Gt("d", 0.5)) == [1] and ids(Q.Lt("d", 2.0)) == [1] and ids(Q.Eq("d", math.nan)) == []
    assert ids(Q.Not(Q.Gt("d", 0.5))) == [2, 3]
    assert ids(Q.Range("n", 5, 7)) == [1] and ids(Q.Exists("s")) == [1, 3]
    assert ids(Q.Gt("_id", 1)) == [] and ids(Q.Eq("_id", 2)) == [2]
    assert ids(Q.And()) == [1, 2, 3] and ids(Q.Or()) == []


def test_sort_and_limit_rules(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 5), (4, 1)], "id long, n int")
    fields = TypedFields(df, id="id")
    ids = lambda q: [r["id"] for r in scan(df, q, fields).collect()]
    assert ids(Q.Scan(sort=(Q.SortField("n"),))) == [4, 2, 3, 1]
    assert ids(Q.Scan(sort=(Q.SortField("n", True),))) == [1, 2, 3, 4]
    assert ids(Q.Scan(limit=2)) == [1, 2] and ids(Q.Scan(limit=0)) == []
    assert scan(df, Q.Scan(project=("nothing",)), fields).columns == ["id"]


def test_positive_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS n", "id AS m").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    q = Q.Scan(Q.And(Q.Gt("n", 10), Q.Eq("m", 7)), project=("n",))
    plan = scan(df, q, TypedFields(df, id="id"))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n,10)" in plan and "EqualTo(m,7)" in plan


def test_ranges_of_integers_are_checked():
    import pytest

    from docloom.errors import DocumentError

    for tag, n in ((Tag.I64, 2**63), (Tag.U64, -1), (Tag.U64, 2**64)):
        with pytest.raises(DocumentError):
            Value(tag, n)
