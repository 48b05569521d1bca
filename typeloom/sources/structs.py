"""Schemas as Spark types, and nodes as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.facets import check
from ..functions.types import SimpleType
from ..functions.values import white
from ..plans.model import ANY_TYPE, ComplexType, ElementDecl, Group, Particle, Schema

_EXACT = {"byte": T.ByteType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(), "unsignedByte": T.ShortType(), "unsignedShort": T.IntegerType(), "unsignedInt": T.LongType(), "boolean": T.BooleanType(), "float": T.FloatType(), "double": T.DoubleType()}


def column_type(t: SimpleType) -> T.DataType:
    """The Spark type that holds every value of a simple type; strings where no
    machine type does."""
    if t.variety == "list":
        return T.ArrayType(column_type(t.item))
    if t.variety == "atomic":
        for x in t.chain():
            if x.name in _EXACT:
                return _EXACT[x.name]
    return T.StringType()


def _fields(p: Particle | None, many: bool, depth: int) -> list[T.StructField]:
    if p is None:
        return []
    many = many or p.occurs.high is None or p.occurs.high > 1
    if isinstance(p.term, Group):
        out: dict[str, T.StructField] = {}
        for q in p.term.particles:
            for f in _fields(q, many, depth):
                out[f.name] = T.StructField(f.name, f.dataType if f.name not in out else T.ArrayType(f.dataType), True)
        return list(out.values())
    if isinstance(p.term, ElementDecl):
        kind = struct_type(p.term.type, depth + 1)
        return [T.StructField(p.term.name[1], T.ArrayType(kind) if many else kind, True)]
    return [T.StructField("_any", T.ArrayType(T.StringType()), True)]


def struct_type(t, depth: int = 0, limit: int = 12) -> T.DataType:
    """Attributes as ``_name``, children by name, text of mixed or simple content
    as ``_text``; recursion past the limit is raw text."""
    if isinstance(t, SimpleType):
        return column_type(t)
    if t is ANY_TYPE or depth > limit:
        return T.StringType()
    fields = [T.StructField(f"_{n[1]}", column_type(a.type), not a.required) for n, a in t.attributes.items()]
    fields += _fields(t.particle, False, depth)
    if t.variety == "simple" and t.simple is not None:
        fields.append(T.StructField("_text", column_type(t.simple), True))
    elif t.variety == "mixed":
        fields.append(T.StructField("_text", T.ArrayType(T.StringType()), True))
    return T.StructType(fields)


def schema_to_struct(schema: Schema, element: tuple[str, str]) -> T.StructType:
    """The row type of a global element."""
    kind = struct_type(schema.elements[element].type)
    return kind if isinstance(kind, T.StructType) else T.StructType([T.StructField("_text", kind)])


def flat_rows(nodes: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """One row per element of a name: text of its children and values of its
    attributes (``@name``).  Nodes that have ``fields`` hold all of it in one row;
    others need an aggregation inside each document."""
    kids = [c for c in columns if not c.startswith("@")]
    mine = nodes.where(F.col("name") == name)
    attr = lambda c: F.get(F.transform(F.filter("attrs", lambda a: a["name"] == c[1:]), lambda a: a["value"]), 0)
    own = mine.select("doc_id", "node_id", *[attr(c).alias(c[1:]) for c in columns if c.startswith("@")])
    if not kids:
        return own
    if "fields" in nodes.columns:
        least = lambda c: F.array_min(F.transform(F.filter("fields", lambda f: f["name"] == c), lambda f: f["text"]))
        return mine.select("doc_id", "node_id", *[attr(c).alias(c[1:]) for c in columns if c.startswith("@")], *[least(c).alias(c) for c in kids])
    per = nodes.where(F.col("name").isin(*kids)).groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(*[F.min(F.when(F.col("name") == c, F.col("text"))).alias(c) for c in kids])
    return own.join(per, ["doc_id", "node_id"], "left")


def native(raw: Column, t: SimpleType) -> Column:
    """A valid literal as the Spark type that holds it; null otherwise.  Values
    that no machine type holds exactly stay text."""
    kind = column_type(t)
    c = white(raw, t.white_space() if t.variety != "union" else "preserve")
    if isinstance(kind, T.BooleanType):
        value = c.isin("true", "1")
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        value = F.when(c.endswith("INF"), F.when(c.startswith("-"), F.lit("-Infinity")).otherwise("Infinity")).otherwise(c).try_cast(kind)
    elif isinstance(kind, T.ArrayType):
        value = F.filter(F.split(white(raw, "collapse"), " "), lambda x: x != "").cast(kind)
    else:
        value = c.try_cast(kind)
    return F.when(check(raw, t).isNull(), value)


def encode(df: DataFrame, root: str) -> DataFrame:
    """Rows as XML: ``_name`` columns are attributes, the others children."""
    xml = F.to_xml(F.struct(*[F.col(c) for c in df.columns]), {"rowTag": root, "attributePrefix": "_", "valueTag": "_text", "indent": ""})
    return df.select("*", xml.alias("xml"))
