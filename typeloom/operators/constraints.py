"""Identity constraints of a schema over assessed nodes.

One frame per constraint and host element: the targets its selector reaches, for
each target and field the nodes with a typed value, then the clauses.  A field
node without a verdict (no simple type, nilled, or empty where the declaration
has a value) declines the frame, which then charges nothing more, and a
reference to a key with a declined frame below its host is not charged.

A path without ``.//`` is one join a step on (document, parent), one with it a
join on (document, ancestor); a field on the target itself costs no step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.facets import Undecided, check
from ..functions.facets import key as typed_key
from ..functions.types import SimpleType
from ..functions.values import white
from ..plans.model import ComplexType, Constraint
from ..sources.staging import stage
from ..sources.xml_nodes import qname
from .identity import RULE
from .paths import Declined, Path, _below, compile_path, node_tables

_VALUE = "struct<st: int, k: string>"
_HOST = ("doc_id", "host_id")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def _named(column: Column, name: str | None) -> Column:
    if name is None or name == "*":
        return F.lit(True)
    return column.startswith(name) if name.endswith("}") else column == name


def reach(nodes: DataFrame, starts: DataFrame, p: Path) -> DataFrame:
    """Rows of ``nodes`` that a path reaches from each start (``doc_id,
    start_id, start_last, start_depth``), with ``start_id``."""
    if p.deep:
        return _below(nodes, starts.select("doc_id", F.col("start_id").alias("host_id"), F.col("start_last").alias("host_last"), F.col("start_depth").alias("host_depth")), [p]).drop("host_last", "host_depth").withColumnRenamed("host_id", "start_id")
    at = starts.select("doc_id", "start_id", F.col("start_id").alias("node_id"))
    for name in p.steps[:-1]:
        step = nodes.where(_named(F.col("name"), name)).select("doc_id", F.col("parent_id").alias("up"), "node_id")
        at = step.join(at.withColumnRenamed("node_id", "up"), ["doc_id", "up"]).drop("up")
    if not p.steps:
        return nodes.join(at, ["doc_id", "node_id"])
    return nodes.where(_named(F.col("name"), p.steps[-1])).join(at.withColumnRenamed("node_id", "parent_id"), ["doc_id", "parent_id"])


class Identity:
    """The constraints of an assessment's declarations, over its typed nodes."""

    def __init__(self, assessment):
        self.a = assessment
        self.spaces: list[SimpleType] = []  # values are compared within one type only
        self.hosts: dict[str, tuple[Constraint, list[int]]] = {}
        for i, e in enumerate(assessment.decls):
            for c in e.constraints:
                self.hosts.setdefault(qname(*c.name), (c, []))[1].append(i)

    def _space(self, t: SimpleType) -> int:
        if t not in self.spaces:
            self.spaces.append(t)
        return self.spaces.index(t)

    def _value(self, raw: Column, bindings: Column, t: SimpleType) -> Column:
        """``STRUCT<st, k>``; k is null for a literal outside the type."""
        # what equals nothing, as NaN, is still identical to itself
        k = F.coalesce(typed_key(raw, t, bindings), F.concat(F.lit("same:"), white(raw, "collapse")))
        return F.struct(F.lit(self._space(t)).alias("st"), F.when(check(raw, t, bindings).isNull(), k).alias("k"))

    def _elements(self) -> Column:
        """The value of an element as a field node; null where declined."""
        value: dict[int, Column] = {}
        for i, t in enumerate(self.a.types):
            s = t if isinstance(t, SimpleType) else t.simple if t.variety == "simple" else None
            if s is not None and self.a._live(i):
                try:
                    value[i] = self._value(F.col("text"), F.col("bindings"), s)
                except Undecided:
                    pass
        given = [i for i, e in enumerate(self.a.decls) if e.default is not None or e.fixed is not None]
        replaced = (F.col("text") == "") & (F.col("decl").isin(*given) if given else F.lit(False))
        return F.when(~F.col("nilled") & ~replaced, self.a._case("type", value, F.lit(None).cast(_VALUE)))

    def _attributes(self, name: str | None) -> Column:
        """The same of an attribute (columns ``name, value, type, bindings``)."""
        uses: list[tuple[SimpleType, list[str]]] = []
        names: list[str] = []
        test = lambda n: name in (None, "*") or (n.startswith(name) if name.endswith("}") else n == name)
        for i, t in enumerate(self.a.types):
            if isinstance(t, ComplexType) and self.a._live(i):
                for n, use in t.attributes.items():
                    if test(qname(*n)):
                        group = next((g for s, g in uses if s == use.type), None)
                        if group is None:
                            uses.append((use.type, group := []))
                        group.append(f"{i}|{qname(*n)}")
                        names.append(group[-1])
        key = F.concat_ws("|", F.col("type").cast("string"), "a_name")
        out = F.lit(None).cast(_VALUE)
        for n, use in self.a.schema.attributes.items():  # for what no use matches
            if test(qname(*n)):
                try:
                    own = ~key.isin(*names) if names else F.lit(True)
                    out = F.when((F.col("a_name") == qname(*n)) & own, self._value(F.col("a_value"), F.col("bindings"), use.type)).otherwise(out)
                except Undecided:
                    pass
        for s, keys in uses:
            try:
                out = F.when(key.isin(*keys), self._value(F.col("a_value"), F.col("bindings"), s)).otherwise(out)
            except Undecided:
                pass
        return out

    def violations(self, nodes: DataFrame) -> DataFrame:
        """All charges; ``nodes`` are typed, with ``nilled``, and ``attrs`` that
        defaults are part of."""
        nillable = [i for i, e in enumerate(self.a.decls) if e.nillable]
        nodes = nodes.withColumn("nillable", F.col("decl").isin(*nillable) if nillable else F.lit(False)).withColumn("nilled", F.col("nilled") & F.col("nillable"))
        nodes = nodes.select("doc_id", "node_id", "parent_id", "last_id", "depth", "name", "path", "ups", "attrs", "text", "bindings", "decl", "type", "nilled", "nillable", "line", "column")
        made = {n: self._frames(nodes, c, decls) for n, (c, decls) in self.hosts.items()}
        out: list[DataFrame] = []
        for n, (c, _) in self.hosts.items():
            if made[n] is not None:
                out += self._own(c, *made[n])
                if c.kind == "keyref":
                    out.append(self._references(nodes, c, made))
        rows = [d.select("doc_id", "node_id", "rule", "clause", "cause", "line", "column") for d in out]
        return _union(rows) if rows else nodes.where(F.lit(False)).select("doc_id", "node_id", F.lit(RULE).alias("rule"), F.lit("").alias("clause"), F.lit("").alias("cause"), "line", "column")

    def _at(self, nodes: DataFrame, name: str) -> DataFrame:
        return nodes.where(F.col("decl").isin(*self.hosts[name][1])).select("doc_id", F.col("node_id").alias("start_id"), F.col("last_id").alias("start_last"), F.col("depth").alias("start_depth"))

    def _frames(self, nodes: DataFrame, c: Constraint, decls: list[int]) -> tuple[DataFrame, DataFrame] | None:
        """(targets with ``s0 ...``, the valued nodes of each field; per host
        ``bad``, the first declined slot, and ``extra``); None for paths outside
        the subset."""
        try:
            selector, fields = compile_path(c.selector, False), [compile_path(f, True) for f in c.fields]
        except Declined:
            return None
        hosts = self._at(nodes, qname(*c.name))
        at = ("doc_id", F.col("start_id").alias("host_id"), F.col("node_id").alias("target_id"), F.col("last_id").alias("target_last"), F.col("depth").alias("target_depth"), "line", "column")
        targets = _union([reach(nodes, hosts, p).select(*at) for p in selector]).distinct()
        if len(fields) > 1 or any(p.steps or p.deep for f in fields for p in f):
            targets = stage(targets, "targets")
        starts = targets.select("doc_id", F.col("target_id").alias("start_id"), F.col("target_last").alias("start_last"), F.col("target_depth").alias("start_depth")).distinct()
        table = targets
        for i, paths in enumerate(fields):
            found = []
            for p in paths:
                hit = reach(nodes, starts, p)
                base = ("doc_id", F.col("start_id").alias("target_id"), "node_id", "line", "column")
                if p.attribute is None:
                    found.append(hit.select(*base, F.lit("").alias("a_name"), "nillable", self._elements().alias("v")))
                else:
                    one = hit.select("*", F.explode("attrs").alias("a")).select("*", F.col("a.name").alias("a_name"), F.col("a.value").alias("a_value")).where(_named(F.col("a_name"), p.attribute))
                    found.append(one.select(*base, "a_name", F.lit(False).alias("nillable"), self._attributes(p.attribute).alias("v")))
            hits = _union(found)
            if len(paths) > 1:  # a union of paths is a set of nodes
                hits = hits.dropDuplicates(["doc_id", "target_id", "node_id", "a_name"])
            valued = F.when(F.col("v.k").isNotNull(), F.struct("node_id", "a_name", "v", "nillable", "line", "column"))
            per = hits.groupBy("doc_id", "target_id").agg(F.bool_or(F.col("v").isNull()).alias(f"d{i}"), F.sort_array(F.collect_list(valued)).alias(f"s{i}"))
            table = table.join(per, ["doc_id", "target_id"], "left")
        table = stage(table, "key-table")
        n = range(len(fields))
        where = [F.when(F.col(f"d{i}"), F.struct("target_id", F.lit(i).alias("i"))) for i in n]
        many = reduce(lambda a, b: a | b, [F.coalesce(F.size(f"s{i}") > 1, F.lit(False)) for i in n])
        frames = table.groupBy(*_HOST).agg(F.min(F.coalesce(*where)).alias("bad"), F.bool_or(many).alias("extra"))
        return table, frames

    def _qualified(self, c: Constraint, table: DataFrame, frames: DataFrame) -> DataFrame:
        good = table.join(frames.where("bad is null and not extra").select(*_HOST), list(_HOST))
        full = reduce(lambda a, b: a & b, [F.coalesce(F.size(f"s{i}") == 1, F.lit(False)) for i in range(len(c.fields))])
        return good.withColumn("full", full).withColumn("key", F.when(full, F.array(*[F.get(f"s{i}", 0)["v"] for i in range(len(c.fields))])))

    def _own(self, c: Constraint, table: DataFrame, frames: DataFrame) -> list[DataFrame]:
        """Clauses 3, 4.1 and 4.2."""
        charge = lambda d, clause: d.withColumn("rule", F.lit(RULE)).withColumn("clause", F.lit(clause)).withColumn("cause", F.lit(qname(*c.name)))
        at = lambda s: ("doc_id", s["node_id"].alias("node_id"), s["line"].alias("line"), s["column"].alias("column"))
        target = ("doc_id", F.col("target_id").alias("node_id"), "line", "column")
        out = []
        for i in range(len(c.fields)):
            before = F.col("bad").isNull() | (F.struct("target_id", F.lit(i).alias("i")) < F.col("bad"))
            out.append(charge(table.where(F.size(f"s{i}") > 1).join(frames.where("extra"), list(_HOST)).where(before).select(*at(F.get(f"s{i}", 1))), "3"))
        if c.kind == "keyref":
            return out
        q = self._qualified(c, table, frames)
        first = q.where("full").groupBy(*_HOST, "key").agg(F.min("target_id").alias("first_id"), F.count("*").alias("c")).where("c > 1")
        out.append(charge(q.where("full").join(first, [*_HOST, "key"]).where("target_id > first_id").select(*target), "4.2.2" if c.kind == "key" else "4.1"))
        if c.kind == "key":
            out.append(charge(q.where("not full").select(*target), "4.2.1"))
            for i in range(len(c.fields)):
                s = F.get(f"s{i}", 0)
                out.append(charge(q.where("full").where(s["nillable"]).select(*at(s)), "4.2.3"))
        return out

    def _references(self, nodes: DataFrame, c: Constraint, made: dict) -> DataFrame:
        """Clause 4.3, against the node table that each host has of the key."""
        name = qname(*c.refer)
        refs = self._qualified(c, *made[qname(*c.name)]).where("full")
        hosts = self._at(nodes, qname(*c.name))
        if name in self.hosts:
            keys = self._at(nodes, name)
            if made[name] is None:
                declined = keys.select("doc_id", F.col("start_id").alias("d_id"))
                table = None
            else:
                own, frames = made[name]
                declined = frames.where("bad is not null or extra").select("doc_id", F.col("host_id").alias("d_id"))
                table = self._node_table(nodes, hosts, keys, self._qualified(self.hosts[name][0], own, frames).where("full"))
            h, d = hosts.alias("h"), declined.alias("d")
            below = (F.col("h.doc_id") == F.col("d.doc_id")) & F.col("d.d_id").between(F.col("h.start_id"), F.col("h.start_last"))
            refs = refs.join(h.join(d, below, "left_semi").select("doc_id", F.col("start_id").alias("host_id")), list(_HOST), "left_anti")
            if table is not None:
                refs = refs.join(table, [*_HOST, "key"], "left_anti")
                for j in range(len(c.fields)):  # a value of another type is no answer
                    prefix = F.slice("key", 1, j)
                    kinds = table.groupBy(*_HOST, prefix.alias("prefix")).agg(F.min(F.get("key", j)["st"]).alias("lo"), F.max(F.get("key", j)["st"]).alias("hi"))
                    st = F.get("key", j)["st"]
                    refs = refs.withColumn("prefix", prefix).join(kinds, [*_HOST, "prefix"], "left").where(F.coalesce((F.col("lo") == st) & (F.col("hi") == st), F.lit(True))).drop("prefix", "lo", "hi")
        return refs.select("doc_id", F.col("target_id").alias("node_id"), F.lit(RULE).alias("rule"), F.lit("4.3").alias("clause"), F.lit(qname(*c.name)).alias("cause"), "line", "column")

    def _node_table(self, nodes: DataFrame, hosts: DataFrame, keys: DataFrame, qualified: DataFrame) -> DataFrame:
        """``(doc_id, host_id, key)``: what references at ``hosts`` can reach.
        Keys move outwards element by element, so every element between counts."""
        entries = stage(qualified.groupBy(*_HOST, "key").agg(F.min("target_id").alias("target_id")), "entries")
        lo, hi = hosts.agg(F.min("start_depth")).first()[0], keys.agg(F.max("start_depth")).first()[0]
        if lo is not None and hi is not None and lo < hi:
            spine = nodes.where(F.col("depth").between(lo, hi)).select("doc_id", F.col("node_id").alias("host_id"), F.col("last_id").alias("host_last"), F.col("depth").alias("host_depth"), F.col("parent_id").alias("up_id"))
            entries = node_tables(entries, spine.drop("up_id"), spine.select("doc_id", "host_id", "up_id"))
        return entries.select(*_HOST, "key")
