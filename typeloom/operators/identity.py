"""Keys, uniqueness and references in table form.

Each constraint is an aggregation or an anti join over ordinary tables, on the
typed key of each field, so ``01`` and ``1`` are one integer key.  Only keys are
shuffled; duplicates are found by a count that combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..functions.facets import key as typed_key
from ..functions.types import BUILTINS, SimpleType

RULE = "cvc-identity-constraint"


def _keys(df: DataFrame, fields: Sequence[str], types: Sequence[SimpleType] | None) -> list[Column]:
    types = types or [BUILTINS["string"]] * len(fields)
    out = []
    for i, (f, t) in enumerate(zip(fields, types)):
        if t.variety == "atomic" and t.primitive() == "decimal" and isinstance(df.schema[f].dataType, IntegralType):
            k = F.concat(F.lit("decimal:"), F.col(f).cast("string"))  # a whole number's text is canonical
        else:
            k = typed_key(F.col(f).cast("string"), t)
        out.append(k.alias(f"_k{i}"))
    return out


def violations(df: DataFrame, clause: str, *columns: str) -> DataFrame:
    return df.select(F.lit(RULE).alias("rule"), F.lit(clause).alias("clause"), *columns)


def duplicates(df: DataFrame, fields: Sequence[str], order: Sequence[str], types: Sequence[SimpleType] | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """Rows whose complete key an earlier row of the scope has (unique, 4.1; for
    keys 4.2.2).  Rows with a missing field are no members.  The first row of a
    key is its least by ``order``; of rows that tie for it one, whichever, counts
    as first.  A key's rows are never brought together, but for such ties."""
    names = [f"_k{i}" for i in range(len(fields))]
    at = [*scope, *names]
    keyed = df.select("*", *_keys(df, fields, types)).withColumn("_o", F.struct(*order))
    # combined before the shuffle; a null equals nothing in the join
    again = keyed.groupBy(*at).agg(F.min("_o").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    met = keyed.join(again, at)
    later = met.where("_o > _first")
    ties = met.where("_o <=> _first").withColumn("_r", F.row_number().over(Window.partitionBy(*at).orderBy("_o"))).where("_r > 1").drop("_r")
    return later.unionByName(ties).drop("_o", "_first", *names)


def repeated(df: DataFrame, fields: Sequence[str], types: Sequence[SimpleType] | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """How many rows of each complete key come after its first, for keys that
    repeat: scope, fields (a literal of the key: of several, the least) and
    ``later``.  One aggregation; whole numbers meet as numbers."""
    types = types or [BUILTINS["string"]] * len(fields)
    names = [f"_k{i}" for i in range(len(fields))]
    plain = [t.variety == "atomic" and t.primitive() == "decimal" and isinstance(df.schema[f].dataType, IntegralType) for f, t in zip(fields, types)]
    keys = [F.col(f).alias(n) if same else k for f, n, same, k in zip(fields, names, plain, _keys(df, fields, types))]
    literals = [f for f, same in zip(fields, plain) if not same]
    keyed = df.select(*scope, *keys, *literals)
    for n in names:
        keyed = keyed.where(F.col(n).isNotNull())
    per = keyed.groupBy(*scope, *names).agg((F.count("*") - 1).alias("later"), *[F.min(f).alias(f) for f in literals]).where("later > 0")
    return per.select(*scope, *[F.col(n).alias(f) if same else F.col(f) for f, n, same in zip(fields, names, plain)], "later")


def incomplete(df: DataFrame, fields: Sequence[str], types: Sequence[SimpleType] | None = None) -> DataFrame:
    """Rows without some field of a key, or with one that is no valid value
    (4.2.1)."""
    missing = F.lit(False)
    for k in _keys(df, fields, types):
        missing = missing | k.isNull()
    return df.where(missing)


def dangling(df: DataFrame, fields: Sequence[str], target: DataFrame, key: Sequence[str], types: Sequence[SimpleType] | None = None, scope: Sequence[str] = ()) -> DataFrame:
    """Rows whose complete reference no row of the target has (4.3)."""
    names = [f"_k{i}" for i in range(len(fields))]
    left = df.select("*", *_keys(df, fields, types))
    right = target.select(*scope, *_keys(target, key, types))
    lost = left.join(right, [*scope, *names], "left_anti")
    for n in names:
        lost = lost.where(F.col(n).isNotNull())
    return lost.drop(*names)


def id_violations(ids: DataFrame, refs: DataFrame, scope: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``cvc-id``: ids bound to several elements (clause 2), references to no id
    (clause 1).  ``ids`` and ``refs`` have the scope and ``value``, ``node_id``;
    one element with the same id twice is one binding."""
    bound = ids.select(*scope, "value", "node_id").distinct()
    twice = bound.groupBy(*scope, "value").agg(F.count("*").alias("n")).where("n > 1").select(*scope, "value")
    lost = refs.select(*scope, "value").distinct().join(bound.select(*scope, "value"), [*scope, "value"], "left_anti")
    made = lambda d, clause: d.select(*scope, "value", F.lit("cvc-id").alias("rule"), F.lit(clause).alias("clause"))
    return made(twice, "2").unionByName(made(lost, "1"))
