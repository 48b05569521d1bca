"""Schema components: immutable after compilation, on the driver.

A component is metadata of bounded size; what the data needs of it becomes
literals in expressions or small tables that are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Union

from pyspark.sql import DataFrame, SparkSession

from ..functions.types import BUILTINS, XSD, SimpleType
from .namespaces import Occurs, Wildcard

QName = tuple[str, str]


class SchemaError(ValueError):
    """A schema that breaks a rule, at a line and column of a document."""

    def __init__(self, rule: str, message: str, where: tuple[str, int, int] = ("?", 0, 0)):
        super().__init__(f"{where[0]}:{where[1]}:{where[2]}: [{rule}] {message}" if rule else message)
        self.rule, self.message, self.where = rule, message, where


@dataclass
class Particle:
    occurs: Occurs
    term: Union["ElementDecl", "Group", Wildcard]


@dataclass
class Group:
    compositor: str  # sequence, choice, all
    particles: list[Particle] = field(default_factory=list)
    name: QName | None = None


@dataclass
class Attribute:
    name: QName
    type: SimpleType
    default: str | None = None
    fixed: str | None = None
    required: bool = False
    prohibited: bool = False
    inheritable: bool = False


@dataclass
class XPath:
    expression: str
    bindings: dict[str, str]
    default: str = ""


@dataclass
class Constraint:
    kind: str  # key, unique, keyref
    name: QName
    selector: XPath
    fields: list[XPath]
    refer: QName | None = None


@dataclass
class Alternative:
    test: XPath | None
    type: "Type"


@dataclass(eq=False)
class ElementDecl:
    name: QName
    type: "Type" = None
    nillable: bool = False
    abstract: bool = False
    default: str | None = None
    fixed: str | None = None
    heads: list[QName] = field(default_factory=list)
    block: frozenset[str] = frozenset()
    final: frozenset[str] = frozenset()
    alternatives: list[Alternative] = field(default_factory=list)
    constraints: list[Constraint] = field(default_factory=list)
    is_global: bool = False
    where: tuple[str, int, int] = ("?", 0, 0)


@dataclass(eq=False)
class ComplexType:
    name: QName | None
    base: "Type | None" = None
    derivation: str = "restriction"
    variety: str = "empty"  # empty, simple, element-only, mixed
    particle: Particle | None = None
    simple: SimpleType | None = None
    attributes: dict[QName, Attribute] = field(default_factory=dict)
    wildcard: Wildcard | None = None
    open_content: tuple[str, Wildcard] | None = None
    abstract: bool = False
    block: frozenset[str] = frozenset()
    final: frozenset[str] = frozenset()
    assertions: list[XPath] = field(default_factory=list)
    where: tuple[str, int, int] = ("?", 0, 0)


Type = Union[SimpleType, ComplexType]
ANY_TYPE = ComplexType((XSD, "anyType"), variety="mixed", particle=Particle(Occurs(), Group("sequence", [Particle(Occurs(0, None), Wildcard(process="lax"))])), wildcard=Wildcard(process="lax"))


@dataclass
class Schema:
    """All components, by kind and expanded name, in document order."""

    types: dict[QName, Type] = field(default_factory=lambda: {(XSD, n): t for n, t in BUILTINS.items()} | {(XSD, "anyType"): ANY_TYPE})
    elements: dict[QName, ElementDecl] = field(default_factory=dict)
    attributes: dict[QName, Attribute] = field(default_factory=dict)
    groups: dict[QName, Group] = field(default_factory=dict)
    attribute_groups: dict[QName, tuple[dict[QName, Attribute], Wildcard | None]] = field(default_factory=dict)
    notations: dict[QName, tuple[str | None, str | None]] = field(default_factory=dict)
    constraints: dict[QName, Constraint] = field(default_factory=dict)
    report: list[tuple[str, str, str]] = field(default_factory=list)  # (document, directive, outcome)

    # queries -------------------------------------------------------------

    def derivation(self, sub: Type, super_: Type) -> list[str] | None:
        """The methods on the way from a type to an ancestor; None if it is none."""
        if super_ is ANY_TYPE:
            out, t = [], sub
            while t is not None and t is not ANY_TYPE:
                out.append(t.derivation if isinstance(t, ComplexType) else "restriction")
                t = t.base
            return out
        out, t = [], sub
        while t is not None:
            if t is super_ or (isinstance(t, SimpleType) and isinstance(super_, SimpleType) and t == super_):
                return out
            if isinstance(super_, SimpleType) and super_.variety == "union" and isinstance(t, SimpleType) and any(self.derivation(t, m) is not None for m in super_.members):
                return out
            out.append(t.derivation if isinstance(t, ComplexType) else "restriction")
            t = t.base
        return None

    def substitutable(self, sub: Type, super_: Type, blocked: frozenset[str] = frozenset()) -> bool:
        """May an instance of ``sub`` stand where ``super_`` is asked for?"""
        way = self.derivation(sub, super_)
        own = super_.block if isinstance(super_, ComplexType) else frozenset()
        return way is not None and not (set(way) & (blocked | own))

    def members(self, head: QName) -> list[ElementDecl]:
        """The substitution group of a global element, itself first."""
        top = self.elements[head]
        out, todo = [top], [head]
        while todo:
            h = todo.pop()
            for e in self.elements.values():
                if h in e.heads and e not in out:
                    todo.append(e.name)
                    if "substitution" not in top.block and self.substitutable(e.type, top.type, top.block):
                        out.append(e)
        return out

    def catalog(self, spark: SparkSession) -> dict[str, DataFrame]:
        """Small tables of the components, with their order."""
        q = lambda n: f"{{{n[0]}}}{n[1]}" if n and n[0] else (n[1] if n else None)
        own = [(n, t) for n, t in self.types.items() if n[0] != XSD]
        name = lambda t: q((XSD, t.name)) if isinstance(t, SimpleType) and t.name in BUILTINS else (q(t.name) if isinstance(t, ComplexType) else t.name)
        frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
        return {
            "types": frame([(i, q(n), "complex" if isinstance(t, ComplexType) else "simple", t.variety, name(t.base) if t.base else None) for i, (n, t) in enumerate(own)], "ord int, name string, kind string, variety string, base string"),
            "elements": frame([(i, q(n), name(e.type), e.abstract, e.nillable) for i, (n, e) in enumerate(self.elements.items())], "ord int, name string, type string, abstract boolean, nillable boolean"),
            "attributes": frame([(i, q(t.name), q(n), a.required, a.default, a.fixed) for i, (t, n, a) in enumerate((t, n, a) for _, t in own if isinstance(t, ComplexType) for n, a in t.attributes.items())], "ord int, type string, name string, required boolean, default string, fixed string"),
            "facets": frame([(q(n), f.kind, list(f.values), f.fixed) for n, t in own if isinstance(t, SimpleType) for f, _ in t.effective()], "type string, kind string, values array<string>, fixed boolean"),
            "constraints": frame([(q(n), c.kind, c.selector.expression, [f.expression for f in c.fields], q(c.refer)) for n, c in self.constraints.items()], "name string, kind string, selector string, fields array<string>, refer string"),
            "substitutions": frame([(q(h), q(m.name)) for h in self.elements for m in self.members(h)], "head string, member string"),
            "documents": frame(self.report, "document string, directive string, outcome string"),
        }


class SchemaBuilder:
    """Components put together by a program, without any document."""

    def __init__(self) -> None:
        self.schema = Schema()

    def _add(self, store: dict, name: QName, component) -> "SchemaBuilder":
        if name in store:
            raise SchemaError("sch-props-correct", f"{name[1]} twice")
        store[name] = component
        return self

    def type(self, name: QName, t: Type) -> "SchemaBuilder":
        return self._add(self.schema.types, name, t)

    def element(self, e: ElementDecl) -> "SchemaBuilder":
        e.is_global = True
        for c in e.constraints:
            self._add(self.schema.constraints, c.name, c)
        return self._add(self.schema.elements, e.name, e)

    def attribute(self, a: Attribute) -> "SchemaBuilder":
        return self._add(self.schema.attributes, a.name, a)

    def group(self, name: QName, g: Group) -> "SchemaBuilder":
        return self._add(self.schema.groups, name, g)

    def notation(self, name: QName, public: str | None = None, system: str | None = None) -> "SchemaBuilder":
        if public is None and system is None:
            raise SchemaError("n-props-correct", "a notation needs public or system")
        return self._add(self.schema.notations, name, (public, system))

    def build(self) -> Schema:
        """The schema, checked like a compiled one."""
        from .checks import check

        check(self.schema)
        return self.schema
