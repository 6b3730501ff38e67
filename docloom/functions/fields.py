"""Field access, in two representations behind one interface.

*Typed*: a DataFrame with a column per field.  Predicates reach the Parquet scan
and unread columns are pruned; NULL means that the field is missing, so a null
value that is present can't be told from it.

*Tagged*: a map from field names to tagged values (``STORED``), for collections
whose documents differ.  It keeps types, presence and null exactly.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import LANE, ORDERED, Tag, Value

ID, VERSION, DELETED = "_id", "_version", "_deleted"


def tag_of(kind: T.DataType) -> Tag | None:
    """Tag of a column's type; None for further orderable types such as timestamps."""
    if isinstance(kind, T.BooleanType):
        return Tag.BOOL
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Tag.I64
    if isinstance(kind, T.DecimalType) and kind.scale == 0:
        return Tag.U64
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return Tag.F64
    if isinstance(kind, T.StringType):
        return Tag.STRING
    if isinstance(kind, T.BinaryType):
        return Tag.BYTES
    if isinstance(kind, T.ArrayType):
        return Tag.ARRAY
    if isinstance(kind, (T.StructType, T.MapType)):
        return Tag.DOCUMENT
    return None


def canonical(c: Column, kind: T.DataType) -> Column:
    """The canonical text of a typed value, null for null; fields of a struct that are null are missing."""
    tag = tag_of(kind)
    if tag == Tag.ARRAY:
        inner = F.transform(c, lambda x: F.coalesce(canonical(x, kind.elementType), F.lit("[0,null]")))
    elif isinstance(kind, T.StructType):
        parts = [canonical(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        inner = F.when(c.isNotNull(), F.struct(*parts)) if parts else F.when(c.isNotNull(), F.create_map().cast("map<string,string>"))
    elif tag == Tag.DOCUMENT:
        value = lambda x: F.coalesce(canonical(x, kind.valueType), F.lit("[0,null]"))
        pairs = F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("key"), value(e["value"]).alias("value")))
        inner = F.map_from_entries(F.array_sort(pairs))
    elif tag == Tag.BYTES:
        return F.concat(F.lit('[6,"'), F.lower(F.hex(c)), F.lit('"]'))
    elif tag == Tag.F64:
        return F.concat(F.lit('[4,"'), (c.cast("double") + F.lit(0.0)).cast("string"), F.lit('"]'))
    elif tag in (Tag.BOOL, Tag.I64, Tag.U64):
        return F.concat(F.lit(f"[{int(tag)},"), c.cast("string"), F.lit("]"))
    else:
        text = F.to_json(F.array(c.cast("string")))
        return F.when(c.isNotNull(), F.concat(F.lit(f"[{int(Tag.STRING)},"), F.substr(text, F.lit(2))))
    return F.concat(F.lit(f"[{int(tag)},"), F.to_json(inner), F.lit("]"))


class TypedFields:
    """A column per field.  ``id`` and ``version`` name the columns that stand for _id and _version."""

    def __init__(self, df: DataFrame, id: str = ID, version: str = VERSION):
        self.kinds = {f.name: f.dataType for f in df.schema.fields}
        self.columns = {ID: id, VERSION: version}
        self.hidden = {ID, VERSION, DELETED, id, version} if id == ID else {ID, VERSION, DELETED}

    def name(self, field: str) -> str | None:
        name = self.columns.get(field, field)
        return name if name in self.kinds else None

    def present(self, field: str) -> Column:
        name = self.name(field)
        return F.col(name).isNotNull() if name else F.lit(False)

    def compare(self, field: str, op: str, value: Value) -> Column | None:
        """The comparison, null where the field is missing; None where it can't hold."""
        name = self.name(field)
        if name is None or value.is_nan or value.tag == Tag.NULL:
            return None
        virtual = field in self.columns
        tag = tag_of(self.kinds[name])
        if op != "eq" and (virtual or tag not in ORDERED):
            return None  # ids have no order for queries
        if virtual and value.tag == Tag.UUID and tag in (Tag.STRING, Tag.BYTES):
            value = Value(tag, value.raw.hex() if tag == Tag.STRING else value.raw)
        if tag != value.tag or tag in (Tag.ARRAY, Tag.DOCUMENT):
            return None
        literal = F.lit(Decimal(value.raw) if tag == Tag.U64 else value.raw)
        c = F.col(name)
        if op == "eq":
            return c == literal
        if op == "lt":
            return c < literal  # NaN is the greatest, so it is out
        return (c > literal if op == "gt" else c >= literal) & ~F.isnan(c) if tag == Tag.F64 else (c > literal if op == "gt" else c >= literal)

    def sort_key(self, field: str) -> Column:
        name = self.name(field)
        return F.col(name) if name else F.lit(None).cast("string")

    def join_key(self, field: str) -> Column | None:
        """What values are equal by in a join, null where the field is missing or NaN."""
        name = self.name(field)
        if name is None:
            return None
        c, tag = F.col(name), tag_of(self.kinds[name])
        return F.when(~F.isnan(c), c) if tag == Tag.F64 else c

    def join_tag(self, field: str) -> Tag | None:
        name = self.name(field)
        return tag_of(self.kinds[name]) if name else None

    def project(self, df: DataFrame, names: tuple[str, ...]) -> DataFrame:
        kept = [c for c in dict.fromkeys((self.columns[ID], self.columns[VERSION], *names)) if c in self.kinds]
        return df.select(*kept)


class TaggedFields:
    """A column ``fields`` of tagged values by name, beside _id, _version and _deleted.

    ``lanes`` names fields that have one type in all documents, each with its tag
    and the column that holds its values; tests and projections use that column.
    """

    def __init__(self, df: DataFrame | None = None, lanes: dict[str, tuple[Tag, str]] | None = None):
        self.kinds: dict = {}
        self.lanes = lanes or {}

    @staticmethod
    def _virtual(field: str) -> Column | None:
        return F.col(field) if field in (ID, VERSION) else None

    def present(self, field: str) -> Column:
        virtual = self._virtual(field)
        if virtual is None and field in self.lanes:
            virtual = F.col(self.lanes[field][1])
        return virtual.isNotNull() if virtual is not None else F.map_contains_key("fields", F.lit(field))

    def compare(self, field: str, op: str, value: Value) -> Column | None:
        if value.is_nan:
            return None
        virtual = self._virtual(field)
        if virtual is not None:
            if op != "eq":
                return None
            if field == ID and value.tag in (Tag.UUID, Tag.STRING):
                return virtual == F.lit(value.raw.hex() if value.tag == Tag.UUID else value.raw)
            return virtual == F.lit(value.raw) if field == VERSION and value.tag in (Tag.I64, Tag.U64) else None
        x = F.col("fields")[field]
        if field in self.lanes:
            if value.tag != self.lanes[field][0]:
                return None
        elif value.tag == Tag.NULL:
            return x["tag"] == int(Tag.NULL) if op == "eq" else None
        if op != "eq" and value.tag not in ORDERED:
            return None
        raw = value.canonical() if value.tag in (Tag.ARRAY, Tag.DOCUMENT) else Decimal(value.raw) if value.tag == Tag.U64 else value.raw
        literal = F.lit(raw)
        if field in self.lanes:
            lane, same = F.col(self.lanes[field][1]), F.lit(True)
        else:
            lane, same = x[LANE[value.tag]], x["tag"] == int(value.tag)
        if op == "eq":
            return same & (lane == literal)
        test = {"gt": lane > literal, "ge": lane >= literal, "lt": lane < literal}[op]
        return same & test & ~F.isnan(lane) if value.tag == Tag.F64 else same & test

    def _lanes(self, field: str) -> Column:
        x = F.col("fields")[field]
        lanes = [x["tag"], x["b"], x["i"], x["u"], x["d"] + F.lit(0.0), x["s"], x["y"], x["c"]]
        names = ("tag", "b", "i", "u", "d", "s", "y", "c")
        return F.struct(*(c.alias(n) for c, n in zip(lanes, names)))

    def sort_key(self, field: str) -> Column:
        """Ordered by type tag, then by value; null where the field is missing."""
        virtual = self._virtual(field)
        if virtual is None and field in self.lanes:
            tag, name = self.lanes[field]
            return F.col(name) + F.lit(0.0) if tag == Tag.F64 else F.col(name)
        return virtual if virtual is not None else F.when(self.present(field), self._lanes(field))

    def join_key(self, field: str) -> Column | None:
        if field == ID:  # an id is the uuid that its hex digits spell
            nothing = [F.lit(None).cast(t).alias(n) for n, t in (("b", "boolean"), ("i", "bigint"), ("u", "decimal(20,0)"), ("d", "double"), ("s", "string"))]
            return F.struct(F.lit(int(Tag.UUID)).cast("tinyint").alias("tag"), *nothing, F.unhex(F.col(ID)).alias("y"), F.lit(None).cast("string").alias("c"))
        if field == VERSION:
            return None
        d = F.col("fields")[field]["d"]
        return F.when(self.present(field) & ~F.coalesce(F.isnan(d), F.lit(False)), self._lanes(field))

    def join_tag(self, field: str) -> Tag | None:
        return None  # each value has its own

    def project(self, df: DataFrame, names: tuple[str, ...]) -> DataFrame:
        if set(names) <= set(self.lanes):
            from .lanes import entries

            kept = entries([(n, *self.lanes[n][:1], F.col(self.lanes[n][1])) for n in dict.fromkeys(names)])
        else:
            kept = F.map_filter("fields", lambda k, _: k.isin(list(names)))
        return df.withColumn("fields", kept).withColumn("_projected", F.lit(True))
