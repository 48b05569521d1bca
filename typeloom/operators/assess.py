"""Assessment of node tables against a schema, as table operations.

Typing is a fold over the path that each node carries: the schema becomes arrays
of literals, by type the declarations of its children's names and by declaration
the types that xsi:type may name, so no join and no recursion is needed.  Every rule is then a
filter, an aggregation or an anti join that yields violations; what has no
verdict yields nothing.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.facets import Undecided, check, matches_fixed, tokens
from ..functions.types import BUILTINS, SimpleType
from ..plans.content import Declined as ModelDeclined
from ..plans.content import automaton
from ..plans.model import ANY_TYPE, ComplexType, ElementDecl, Group, Particle, Schema, Type
from ..plans.namespaces import Wildcard
from ..sources.xml_nodes import SCHEMA, qname
from ..sources.staging import stage
from ..sources.xml_reader import XSI
from .constraints import Identity
from .cta import Declined, compile_test
from .identity import id_violations

LOG = logging.getLogger("typeloom")
UNTYPED = -1
_XSI = [qname(XSI, n) for n in ("type", "nil", "schemaLocation", "noNamespaceSchemaLocation")]


def _map(pairs: dict, kind: str) -> Column:
    if not pairs:
        return F.expr(f"cast(map() as map<string, {kind}>)")
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _particles(p: Particle | None) -> list[Particle]:
    if p is None:
        return []
    if isinstance(p.term, Group):
        return [x for q in p.term.particles for x in _particles(q)]
    return [p]


class Assessment:
    """A schema prepared for tables: numbered types and declarations."""

    #: The columns to shred for ``assess``; with them its nodes do not move.
    COLUMNS = (*SCHEMA.names, "kids")

    def __init__(self, schema: Schema):
        self.schema = schema
        self.types: list[Type] = []
        self.decls: list[ElementDecl] = []
        self.child: dict[int, dict[str, int]] = {UNTYPED: {}}  # by type (a root's above all): name -> declaration
        self.declared: list[int] = []  # type of each declaration
        self.slot: list[int] = []  # what each declaration lets xsi:type name, as a number of ``allowed``
        self.allowed: list[dict[str, int]] = []  # name -> type
        self.slots: dict[tuple[int, frozenset[str]], int] = {}
        self.named: dict[str, int] = {}  # name -> type
        for name, t in schema.types.items():
            self.named[qname(*name)] = self.type_id(t)
        for name, e in schema.elements.items():
            self.child[UNTYPED][qname(*name)] = self.decl_id(e)
        done = 0
        while done < len(self.types):
            t = self.types[done]
            if isinstance(t, ComplexType):
                self._children(done, t)
            done += 1

    def type_id(self, t: Type) -> int:
        for i, x in enumerate(self.types):
            if x is t or (isinstance(x, SimpleType) and isinstance(t, SimpleType) and x == t):
                return i
        self.types.append(t)
        return len(self.types) - 1

    def decl_id(self, e: ElementDecl) -> int:
        for i, x in enumerate(self.decls):
            if x is e:
                return i
        self.decls.append(e)
        i = len(self.decls) - 1
        self.declared.append(self.type_id(e.type))
        # declarations of one type and block let the same types be named
        key = (self.declared[i], e.block)
        if key not in self.slots:
            self.slots[key] = len(self.allowed)
            self.allowed.append({qname(*name): self.type_id(t) for name, t in self.schema.types.items() if self.schema.substitutable(t, e.type, e.block)})
        self.slot.append(self.slots[key])
        return i

    def _children(self, i: int, t: ComplexType) -> None:
        child = self.child.setdefault(i, {})
        wild: list[Wildcard] = [w for w in ([t.open_content[1]] if t.open_content else [])]
        for p in _particles(t.particle):
            if isinstance(p.term, Wildcard):
                wild.append(p.term)
                continue
            members = self.schema.members(p.term.name) if p.term.is_global and p.term.name in self.schema.elements else [p.term]
            for e in members:
                child.setdefault(qname(*e.name), self.decl_id(e))
        for w in wild:
            if w.process == "skip":
                continue
            for name, e in self.schema.elements.items():
                if w.admits(name):
                    child.setdefault(qname(*name), self.decl_id(e))

    # typing --------------------------------------------------------------

    def governance(self, path: Column) -> Column:
        """``STRUCT<decl, type, refused>`` of the last step of a path; decl and
        type are -1 where there is none."""
        # arrays by number, so that a step searches the names of one type only
        child = F.array(*[_map(self.child.get(i, {}), "int") for i in range(UNTYPED, len(self.types))])
        numbers = lambda xs: F.array(*map(F.lit, xs)) if xs else F.lit(None).cast("array<int>")
        declared, slot, named = numbers(self.declared), numbers(self.slot), _map(self.named, "int")
        allowed = F.array(*[_map(m, "int") for m in self.allowed]) if self.allowed else F.lit(None).cast("array<map<string, int>>")

        def step(acc: Column, x: Column) -> Column:
            name = F.substring_index(x, "#", 1)
            asked = F.when(F.instr(x, "#") > 0, F.substring_index(x, "#", -1))
            at = F.when(acc["first"] | (acc["type"] != UNTYPED), acc["type"] - UNTYPED)
            d = F.try_element_at(F.get(child, at), name)
            over = F.try_element_at(F.get(allowed, F.get(slot, d)), asked)
            known = F.try_element_at(named, asked)
            # a root without declaration is governed by the type it names
            own = F.when(d.isNull() & acc["first"], known)
            t = F.coalesce(over, own, F.get(declared, d), F.lit(UNTYPED))
            bad = d.isNotNull() & known.isNotNull() & over.isNull()
            return F.struct(F.lit(False).alias("first"), F.coalesce(d, F.lit(UNTYPED)).alias("decl"), t.alias("type"), bad.alias("refused"))

        start = F.struct(F.lit(True).alias("first"), F.lit(UNTYPED).alias("decl"), F.lit(UNTYPED).alias("type"), F.lit(False).alias("refused"))
        return F.aggregate(path, start, step, lambda a: F.struct(a["decl"], a["type"], a["refused"]))

    def typed(self, nodes: DataFrame) -> DataFrame:
        """Nodes with ``decl``, ``type`` and ``refused`` (null in rows of documents
        that are not well-formed); alternatives of a declaration choose where no
        xsi:type does."""
        g = nodes.withColumn("g", F.when(F.col("rule").isNull(), self.governance(F.col("path")))).select("*", "g.decl", "g.type", "g.refused").drop("g")
        plain = ~F.exists("attrs", lambda a: a["name"] == _XSI[0])
        chosen = F.lit(None).cast("int")
        for i, e in enumerate(self.decls):
            if not e.alternatives:
                continue
            pick = F.lit(self.type_id(e.type))
            for alt in reversed(e.alternatives):
                if alt.test is None:
                    pick = F.lit(self.type_id(alt.type))
                    continue
                try:
                    pick = F.when(compile_test(alt.test, F.col("attrs"), self.schema.types), self.type_id(alt.type)).otherwise(pick)
                except Declined as why:
                    LOG.info("a type alternative of %s is not decided: %s", qname(*e.name), why)
                    pick = F.lit(UNTYPED)
            chosen = F.when(F.col("decl") == i, pick).otherwise(chosen)
        return g.withColumn("type", F.when(plain, F.coalesce(chosen, "type")).otherwise(F.col("type")))

    # rules ---------------------------------------------------------------

    #: Type numbers that occur in the nodes at hand; None for not known.
    present: set[int] | None = None

    def _live(self, i: int) -> bool:
        return self.present is None or i in self.present

    def _case(self, on: str, items: dict[int, Column], other: Column) -> Column:
        out = other
        for i, c in items.items():
            out = F.when(F.col(on) == i, c).otherwise(out)
        return out

    def with_content(self, typed: DataFrame) -> DataFrame:
        """``reject_index`` and ``too_short`` beside each node: its type's model
        over the names of its children.  No verdict for declined models."""
        models: dict[int, Column] = {}
        for i, t in enumerate(self.types):
            if isinstance(t, ComplexType) and t.variety in ("element-only", "mixed") and t is not ANY_TYPE and self._live(i):
                try:
                    models[i] = automaton(t, self.schema).verdict(F.col("children"))
                except ModelDeclined as why:
                    LOG.info("no verdict on the content of %s: %s", qname(*t.name) if t.name else "an anonymous type", why)
        none = F.lit(None).cast("struct<ok: boolean, reject_index: int, too_short: boolean>")
        return typed.withColumn("v", self._case("type", models, none)).select("*", "v.reject_index", "v.too_short").drop("v")

    def assess(self, nodes: DataFrame, observed: Observation | None = None) -> DataFrame:
        """``(doc_id, node_id, rule, clause, cause, line, column)`` of every
        violation, documents that are not well-formed included.  ``observed``
        gets their number, in all and by family of rules, when the result runs."""
        # read by every rule: typed once, in the pass that reads the documents
        every = stage(self.with_content(self.typed(nodes)).drop("children", "message"), "typed")
        typed = every.where("rule is null")
        # only types that occur get an expression: at most as many rows as types
        self.present = {r[0] for r in typed.select("type").distinct().collect()}
        if "kids" in nodes.columns and not any(e.constraints for e in self.decls) and not self._has_ids():
            return self._observed(self._by_violation(every, typed), observed)
        content = typed.where("reject_index is not null or too_short").select("doc_id", "node_id", "last_id", "line", "column", "reject_index", "too_short")
        clean = content.where("reject_index is not null").isEmpty()
        kept = typed if clean else stage(self._kept(typed, content), "kept")
        nil = F.get(F.transform(F.filter("attrs", lambda a: a["name"] == _XSI[1]), lambda a: a["value"]), 0)
        rows = kept.withColumn("nil", nil).withColumn("nilled", F.coalesce(F.trim("nil").isin("true", "1"), F.lit(False)))
        rejected = kept.where("reject_index is not null or too_short").select("doc_id", "node_id", "line", "column", "reject_index", "too_short")
        out = [
            every.where("rule is not null").select("doc_id", F.lit(None).cast("long").alias("node_id"), "rule", F.lit("").alias("clause"), F.lit(None).cast("string").alias("cause"), "line", "column"),
            self._element_rules(rows),
            rejected.where("too_short").select("doc_id", "node_id", F.lit("cvc-complex-content").alias("rule"), F.lit("short").alias("clause"), F.lit(None).cast("string").alias("cause"), "line", "column"),
            *([] if clean else [self._rejected_children(typed, rejected)]),
            self._attribute_rules(rows),
            self._missing_attributes(rows),
            self._ids(rows),
        ]
        if any(e.constraints for e in self.decls):
            out.append(self._identity(typed, kept, nil))
        result = out[0]
        for more in out[1:]:
            result = result.unionByName(more)
        return self._observed(result, observed)

    def _observed(self, result: DataFrame, observed: Observation | None) -> DataFrame:
        if observed is not None:
            family = lambda p: F.count_if(F.col("rule").startswith(p))
            result = result.observe(observed, F.count(F.lit(1)).alias("violations"), family("xml-wf").alias("not_well_formed"), family("cvc-id").alias("identity"), family("cvc-complex").alias("complex_types"), (family("cvc-type") + family("cvc-elt") + family("cvc-attribute")).alias("values"))
        return result

    def _by_violation(self, every: DataFrame, typed: DataFrame) -> DataFrame:
        """The same of nodes that know their children, without keys and ids: nodes
        stay where they are, and what was found at nodes that a content model
        left untyped is taken away afterwards."""
        nil = F.get(F.transform(F.filter("attrs", lambda a: a["name"] == _XSI[1]), lambda a: a["value"]), 0)
        rows = typed.withColumn("nil", nil).withColumn("nilled", F.coalesce(F.trim("nil").isin("true", "1"), F.lit(False)))
        none = F.lit(None).cast("string")
        bad = lambda d, kind: d.select("doc_id", "node_id", F.lit("cvc-complex-content").alias("rule"), F.lit(kind).alias("clause"), none.alias("cause"), "line", "column", F.col("node_id").alias("at"), "ups")
        first = F.get("kids", F.col("reject_index"))
        rejecting = typed.where("reject_index is not null")
        child = rejecting.select("doc_id", F.col("node_id").alias("at"), first["node_id"].alias("node_id"), F.lit("cvc-complex-content").alias("rule"), F.lit("reject").alias("clause"), none.alias("cause"), first["line"].alias("line"), first["column"].alias("column"), "ups")
        made = [bad(typed.where("too_short"), "short"), child.where("node_id is not null")]
        made += [rule(rows, "ups").withColumn("at", F.col("node_id")) for rule in (self._element_rules, self._attribute_rules, self._missing_attributes)]
        found = made[0]
        for more in made[1:]:
            found = found.unionByName(more)
        cut = rejecting.select("doc_id", F.col("node_id").alias("up"), first["node_id"].alias("from_id"))
        if not cut.isEmpty():
            found = stage(found, "found")
            # below a node that rejects, from the rejected child on
            below = found.select("doc_id", "at", F.explode("ups").alias("up")).join(cut, ["doc_id", "up"]).where("at >= from_id").select("doc_id", "at").distinct()
            found = found.join(below, ["doc_id", "at"], "left_anti")
        broken = every.where("rule is not null").select("doc_id", F.lit(None).cast("long").alias("node_id"), "rule", F.lit("").alias("clause"), none.alias("cause"), "line", "column")
        return broken.unionByName(found.drop("at", "ups"))

    def _has_ids(self) -> bool:
        """May a value be an id or a reference to one?"""
        some = F.lit(None).cast("string")
        own = [t if isinstance(t, SimpleType) else t.simple for i, t in enumerate(self.types) if self._live(i)]
        own += [a.type for i, t in enumerate(self.types) if isinstance(t, ComplexType) and self._live(i) for a in t.attributes.values()]
        return any(self._named_ids(some, t, kind, some) is not None for t in own for kind in ("ID", "IDREF"))

    def _kept(self, typed: DataFrame, content: DataFrame) -> DataFrame:
        """Nodes that stay typed: a child from the rejected one on is untyped,
        with all below it."""
        cut = content.where("reject_index is not null").select("doc_id", F.col("node_id").alias("parent_id"), "reject_index")
        heads = typed.drop("reject_index").join(cut, ["doc_id", "parent_id"]).where("sib >= reject_index").select("doc_id", F.col("node_id").alias("from_id"))
        # by the numbers of ancestors, and only in documents that have such a child
        near = typed.join(heads.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "node_id", F.explode(F.concat("ups", F.array("node_id"))).alias("from_id"))
        return typed.join(near.join(heads, ["doc_id", "from_id"], "left_semi"), ["doc_id", "node_id"], "left_anti")

    def _rejected_children(self, typed: DataFrame, rejected: DataFrame) -> DataFrame:
        at = rejected.where("reject_index is not null").select("doc_id", F.col("node_id").alias("parent_id"), F.col("reject_index").alias("sib"))
        return typed.join(at, ["doc_id", "parent_id", "sib"]).select("doc_id", "node_id", F.lit("cvc-complex-content").alias("rule"), F.lit("reject").alias("clause"), F.lit(None).cast("string").alias("cause"), "line", "column")

    def _element_rules(self, rows: DataFrame, *more: str) -> DataFrame:
        """All rules that need only the element's own row, as one array."""
        violation = lambda test, rule, clause, cause=None: F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(clause).alias("clause"), (cause if cause is not None else F.lit(None).cast("string")).alias("cause")))
        ids = lambda test: [i for i, t in enumerate(self.types) if test(t)]
        some = lambda col, items: F.col(col).isin(*items) if items else F.lit(False)
        simple = {i: t for i, t in enumerate(self.types) if isinstance(t, SimpleType) and self._live(i)}
        inner = {i: t.simple for i, t in enumerate(self.types) if isinstance(t, ComplexType) and t.variety == "simple" and t.simple is not None and self._live(i)}
        abstract = [i for i, e in enumerate(self.decls) if e.abstract]
        nillable = [i for i, e in enumerate(self.decls) if e.nillable]
        fixed = {i: e for i, e in enumerate(self.decls) if e.fixed is not None}
        root = F.col("parent_id").isNull()
        content = F.col("has_text") | (F.col("n_children") > 0)
        none = F.lit(None).cast("string")
        value: dict[int, Column] = {}
        for i, t in {**simple, **inner}.items():
            try:
                value[i] = check(F.col("text"), t, F.col("bindings"))
            except Undecided:
                pass
        live = ~F.col("nilled") | ~some("decl", nillable)
        # the clause of a fixed value that an element does not have: 1 for element
        # children, 2.1 of mixed content by its text, 2.2 of a simple value
        agree: dict[int, Column] = {}
        for i, e in fixed.items():
            t = e.type if isinstance(e.type, SimpleType) else e.type.simple
            try:
                same = F.coalesce(matches_fixed(F.col("text"), e.fixed, t, F.col("bindings")), F.lit(True)) if t is not None else F.col("text") == e.fixed
                agree[i] = F.when(F.col("n_children") > 0, "5.2.2.1").when(~same, "5.2.2.2.2" if t is not None else "5.2.2.2.1")
            except Undecided:
                pass
        tests = [
            violation(root & (F.col("type") == UNTYPED) & (F.col("decl") == UNTYPED), "cvc-assess-elt", ""),
            violation(root & some("decl", abstract), "cvc-elt", "2"),
            violation(F.col("refused"), "cvc-elt", "4"),
            violation(F.col("nil").isNotNull() & (F.col("decl") >= 0) & ~some("decl", nillable), "cvc-elt", "3.1"),
            violation(F.col("nil").isNotNull() & some("decl", nillable) & ~F.trim("nil").isin("true", "false", "1", "0"), "cvc-elt", "3.2"),
            violation(F.col("nilled") & some("decl", nillable) & content, "cvc-elt", "3.2.3.1"),
            violation(F.col("nilled") & some("decl", [i for i in fixed if i in nillable]), "cvc-elt", "3.2.3.2"),
            violation(some("type", list(simple)) & (F.col("n_children") > 0), "cvc-type", "3.1.2"),
            violation(some("type", list(simple)) & live & (F.col("n_children") == 0) & F.col("value").isNotNull(), "cvc-type", "3.1.3", F.col("value")),
            violation(some("type", ids(lambda t: isinstance(t, ComplexType) and t.variety == "empty")) & content, "cvc-complex-type", "1.1"),
            violation(some("type", list(inner)) & (F.col("n_children") > 0), "cvc-complex-type", "1.2"),
            violation(some("type", list(inner)) & live & (F.col("n_children") == 0) & F.col("value").isNotNull(), "cvc-complex-type", "1.2", F.col("value")),
            violation(some("type", ids(lambda t: isinstance(t, ComplexType) and t.variety == "element-only")) & ~F.col("blank"), "cvc-complex-type", "1.3"),
        ]
        off = F.when(content & live, self._case("decl", agree, none))
        tests.append(F.when(off.isNotNull(), F.struct(F.lit("cvc-elt").alias("rule"), off.alias("clause"), none.alias("cause"))))
        found = rows.withColumn("value", self._case("type", value, none)).select("doc_id", "node_id", "line", "column", *more, F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("x"))
        return found.select("doc_id", "node_id", "x.rule", "x.clause", "x.cause", "line", "column", *more)

    def _attribute_rules(self, rows: DataFrame, *more: str) -> DataFrame:
        """Attributes one by one: known, valid, and agreeing with fixed values."""
        exploded = rows.where(f"type <> {UNTYPED}").select("doc_id", "node_id", "line", "column", "type", "bindings", *more, F.explode("attrs").alias("a")).select("*", F.col("a.name").alias("name"), F.col("a.value").alias("value")).where(~F.col("name").isin(*_XSI))
        known: dict[str, Column] = {}
        cause: list[tuple[Column, Column]] = []
        differs: list[Column] = []
        undecided, simple = [], []
        verdicts: list[tuple[SimpleType, list[str]]] = []
        names: list[str] = []
        for i, t in enumerate(self.types):
            if not self._live(i):
                continue
            if isinstance(t, SimpleType):
                simple.append(i)
                continue
            if t.wildcard is not None:
                undecided.append(i)
            for n, a in t.attributes.items():
                key = f"{i}|{qname(*n)}"
                names.append(key)
                group = next((g for s, g in verdicts if s == a.type), None)
                if group is None:
                    verdicts.append((a.type, group := []))
                group.append(key)
                if a.fixed is not None:
                    try:
                        differs.append((F.col("key") == key) & ~F.coalesce(matches_fixed(F.col("value"), a.fixed, a.type, F.col("bindings")), F.lit(True)))
                    except Undecided:
                        pass
        for s, keys in verdicts:
            try:
                cause.append((F.col("key").isin(*keys), check(F.col("value"), s, F.col("bindings"))))
            except Undecided:
                pass
        bad = F.lit(None).cast("string")
        for when, verdict in cause:
            bad = F.when(when, verdict).otherwise(bad)
        other = F.lit(False)
        for x in differs:
            other = other | x
        keyed = exploded.withColumn("key", F.concat_ws("|", F.col("type").cast("string"), "name")).withColumn("bad", bad)
        out = keyed.select(
            "doc_id", "node_id", "line", "column", *more,
            F.when(F.col("type").isin(*simple), F.struct(F.lit("cvc-type").alias("rule"), F.lit("3.1.1").alias("clause"), F.lit(None).cast("string").alias("cause")))
            .when(~(F.col("key").isin(*names) if names else F.lit(False)), F.when(~(F.col("type").isin(*undecided) if undecided else F.lit(False)), F.struct(F.lit("cvc-complex-type").alias("rule"), F.lit("2").alias("clause"), F.lit(None).cast("string").alias("cause"))))
            .when(F.col("bad").isNotNull(), F.struct(F.lit("cvc-attribute").alias("rule"), F.lit("3").alias("clause"), F.col("bad").alias("cause")))
            .when(other, F.struct(F.lit("cvc-au").alias("rule"), F.lit("").alias("clause"), F.lit(None).cast("string").alias("cause")))
            .alias("x"),
        ).where("x is not null")
        return out.select("doc_id", "node_id", "x.rule", "x.clause", "x.cause", "line", "column", *more)

    def _missing_attributes(self, rows: DataFrame, *more: str) -> DataFrame:
        needed = {i: [qname(*n) for n, a in t.attributes.items() if a.required] for i, t in enumerate(self.types) if isinstance(t, ComplexType)}
        needed = {i: v for i, v in needed.items() if v}
        wanted = self._case("type", {i: F.array(*[F.lit(x) for x in v]) for i, v in needed.items()}, F.lit(None).cast("array<string>"))
        lost = F.array_except(wanted, F.transform("attrs", lambda a: a["name"]))
        found = rows.where(F.col("type").isin(*needed) if needed else F.lit(False)).select("doc_id", "node_id", "line", "column", *more, F.explode(lost).alias("name"))
        return found.select("doc_id", "node_id", F.lit("cvc-complex-type").alias("rule"), F.lit("3").alias("clause"), F.lit(None).cast("string").alias("cause"), "line", "column", *more)

    # keys ----------------------------------------------------------------

    def with_defaults(self, rows: DataFrame) -> DataFrame:
        """Nodes with the defaulted attributes of their types beside their own."""
        given: dict[int, Column] = {}
        for i, t in enumerate(self.types):
            if isinstance(t, ComplexType) and self._live(i):
                made = [(qname(*n), a.fixed if a.default is None else a.default) for n, a in t.attributes.items() if not a.required and not a.prohibited]
                made = [F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in made if v is not None]
                if made:
                    given[i] = F.array(*made)
        if not given:
            return rows
        names = F.transform("attrs", lambda a: a["name"])
        absent = F.filter(self._case("type", given, F.lit(None).cast("array<struct<name: string, value: string>>")), lambda a: ~F.array_contains(names, a["name"]))
        return rows.withColumn("attrs", F.when(F.col("type").isin(*given), F.concat("attrs", absent)).otherwise(F.col("attrs")))

    def _identity(self, typed: DataFrame, kept: DataFrame, nil: Column) -> DataFrame:
        """Keys, uniqueness and references; what a content model rejected is
        walked as well, without types."""
        nodes = kept
        if kept is not typed:
            lost = typed.join(kept.select("doc_id", "node_id"), ["doc_id", "node_id"], "left_anti")
            nodes = kept.unionByName(lost.withColumn("type", F.lit(UNTYPED)).withColumn("decl", F.lit(UNTYPED)))
        return Identity(self).violations(self.with_defaults(nodes.withColumn("nilled", F.coalesce(F.trim(nil).isin("true", "1"), F.lit(False)))))

    # IDs -----------------------------------------------------------------

    def _named_ids(self, raw: Column, t: SimpleType | None, kind: str, bindings: Column) -> Column | None:
        """The ids (``ID``) or references (``IDREF``) in a literal; of a union, those
        of the member that validates.  None for a type without any."""
        if t is None:
            return None
        if t.variety == "list":
            inner = lambda x: self._named_ids(x, t.item, kind, bindings)
            return None if inner(raw) is None else F.flatten(F.transform(tokens(raw), inner))
        if t.variety == "union":
            made = [(m, self._named_ids(raw, m, kind, bindings)) for m in t.members]
            if all(x is None for _, x in made):
                return None
            none = F.expr("cast(array() as array<string>)")
            try:
                member = F.coalesce(*[F.when(check(raw, m, bindings).isNull(), none if x is None else x) for m, x in made])
                return F.when(check(raw, t, bindings).isNull(), member)
            except Undecided:
                return None
        return tokens(raw) if t.derives_from(kind) else None

    def id_table(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(ids, references) with ``doc_id, node_id, value``: an ID attribute
        binds its owner, an ID element its parent.  Defaulted attributes count."""
        made: list[DataFrame] = []
        full = self.with_defaults(rows)
        none = F.lit(None).cast("array<string>")
        for kind in ("ID", "IDREF"):
            groups: list[tuple[SimpleType, list[str]]] = []
            own: dict[int, Column] = {}
            for i, t in enumerate(self.types):
                if not self._live(i):
                    continue
                found = self._named_ids(F.col("text"), t if isinstance(t, SimpleType) else t.simple, kind, F.col("bindings"))
                if found is not None:
                    own[i] = found
                for n, a in t.attributes.items() if isinstance(t, ComplexType) else ():
                    if self._named_ids(F.col("a.value"), a.type, kind, F.col("bindings")) is not None:
                        group = next((g for s, g in groups if s == a.type), None)
                        if group is None:
                            groups.append((a.type, group := []))
                        group.append(f"{i}|{qname(*n)}")
            key, value = F.concat_ws("|", F.col("type").cast("string"), "a.name"), none
            for s, keys in groups:
                value = F.when(key.isin(*keys), self._named_ids(F.col("a.value"), s, kind, F.col("bindings"))).otherwise(value)
            keys = [k for _, g in groups for k in g]
            a = full.select("doc_id", "node_id", "type", "bindings", F.explode("attrs").alias("a")).where(key.isin(*keys) if keys else F.lit(False)).select("doc_id", "node_id", F.explode(value).alias("value"))
            e = rows.where(F.col("type").isin(*own) if own else F.lit(False)).select("doc_id", (F.coalesce("parent_id", "node_id") if kind == "ID" else F.col("node_id")).alias("node_id"), F.explode(self._case("type", own, none)).alias("value"))
            made.append(a.unionByName(e))
        return made[0], made[1]

    def _ids(self, rows: DataFrame) -> DataFrame:
        ids, refs = self.id_table(rows)
        found = id_violations(ids, refs)
        return found.select("doc_id", F.lit(None).cast("long").alias("node_id"), "rule", "clause", F.col("value").alias("cause"), F.lit(None).cast("int").alias("line"), F.lit(None).cast("int").alias("column"))


def in_document_order(found: DataFrame) -> DataFrame:
    """Violations document by document, in the order of their nodes; what has no
    node, as of references in the whole document, comes last."""
    return found.repartition("doc_id").sortWithinPartitions("doc_id", F.col("node_id").asc_nulls_last(), "rule", "clause", "cause")


def builtin(name: str) -> SimpleType:
    return BUILTINS[name]
