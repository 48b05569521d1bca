"""Builtin and derived simple types: a small immutable model on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

XSD = "http://www.w3.org/2001/XMLSchema"
KINDS = ("length", "minLength", "maxLength", "pattern", "enumeration", "whiteSpace", "maxInclusive", "maxExclusive", "minExclusive", "minInclusive", "totalDigits", "fractionDigits", "explicitTimezone", "maxScale", "minScale", "assertions")


@dataclass(frozen=True)
class Facet:
    """One facet of one derivation step; several values of a pattern or an
    enumeration at one step are alternatives."""

    kind: str
    values: tuple[str, ...]
    fixed: bool = False


@dataclass(frozen=True)
class SimpleType:
    name: str | None
    base: "SimpleType | None" = None
    variety: str = "atomic"
    item: "SimpleType | None" = None
    members: tuple["SimpleType", ...] = ()
    facets: tuple[Facet, ...] = ()
    final: frozenset = field(default_factory=frozenset)
    bindings: tuple[tuple[str, str], ...] = ()

    def chain(self) -> list["SimpleType"]:
        out, t = [], self
        while t is not None:
            out.append(t)
            t = t.base
        return out

    def derives_from(self, name: str) -> bool:
        return any(t.name == name for t in self.chain())

    def primitive(self) -> str | None:
        """The nearest ancestor with a mapping of its own."""
        return next((t.name for t in self.chain() if t.name in MAPPED), None)

    def effective(self) -> list[tuple[Facet, "SimpleType"]]:
        """Facets in force, each with the type that declares it: a step replaces
        its base's facet of the same kind in place; patterns add up."""
        out: list[tuple[Facet, SimpleType]] = []
        for t in reversed(self.chain()):
            for f in t.facets:
                at = next((i for i, (g, _) in enumerate(out) if g.kind == f.kind), None)
                if f.kind in ("pattern", "assertions") or at is None:
                    out.append((f, t))
                else:
                    out[at] = (f, t)
        return out

    def facet(self, kind: str) -> str | None:
        return next((f.values[0] for f, _ in reversed(self.effective()) if f.kind == kind), None)

    def white_space(self) -> str:
        if self.variety == "list":
            return "collapse"
        return self.facet("whiteSpace") or "preserve"


def restrict(base: SimpleType, name: str | None = None, **facets: object) -> SimpleType:
    """A restriction step: values may be one string or a list of them."""
    made = tuple(Facet(k, tuple(v) if isinstance(v, (list, tuple)) else (str(v),)) for k, v in facets.items())
    return SimpleType(name, base, base.variety, base.item, base.members, made)


def list_of(item: SimpleType, name: str | None = None) -> SimpleType:
    return SimpleType(name, ANY_SIMPLE, "list", item=item)


def union_of(*members: SimpleType, name: str | None = None) -> SimpleType:
    return SimpleType(name, ANY_SIMPLE, "union", members=members)


ANY_SIMPLE = SimpleType("anySimpleType")
ANY_ATOMIC = SimpleType("anyAtomicType", ANY_SIMPLE)
ERROR = SimpleType("error", ANY_SIMPLE, "union")

_TIMES = ("dateTime", "time", "date", "gYearMonth", "gYear", "gMonthDay", "gDay", "gMonth")
_LENGTHS = ("length", "minLength", "maxLength")
_BOUNDS = ("maxInclusive", "maxExclusive", "minInclusive", "minExclusive")
_COMMON = ("pattern", "enumeration", "whiteSpace", "assertions")
MAPPED = frozenset(("string", "boolean", "decimal", "float", "double", "precisionDecimal", "duration", "yearMonthDuration", "dayTimeDuration", *_TIMES, "dateTimeStamp", "hexBinary", "base64Binary", "anyURI", "QName", "NOTATION"))

#: Facets that each primitive allows.
APPLICABLE: dict[str, frozenset[str]] = {
    **{p: frozenset((*_COMMON, *_LENGTHS)) for p in ("string", "hexBinary", "base64Binary", "anyURI", "QName", "NOTATION")},
    "boolean": frozenset(("pattern", "whiteSpace", "assertions")),
    "decimal": frozenset((*_COMMON, *_BOUNDS, "totalDigits", "fractionDigits")),
    "precisionDecimal": frozenset((*_COMMON, *_BOUNDS, "totalDigits", "maxScale", "minScale")),
    **{p: frozenset((*_COMMON, *_BOUNDS)) for p in ("float", "double", "duration")},
    **{p: frozenset((*_COMMON, *_BOUNDS, "explicitTimezone")) for p in _TIMES},
    "list": frozenset((*_COMMON, *_LENGTHS)),
    "union": frozenset(("pattern", "enumeration", "assertions")),
}


def _builtins() -> dict[str, SimpleType]:
    out: dict[str, SimpleType] = {"anySimpleType": ANY_SIMPLE, "error": ERROR, "anyAtomicType": ANY_ATOMIC}

    def add(name: str, base: str, *facets: Facet) -> None:
        out[name] = SimpleType(name, out[base], facets=facets)

    collapse = Facet("whiteSpace", ("collapse",), True)
    add("string", "anyAtomicType", Facet("whiteSpace", ("preserve",)))
    for p in ("boolean", "decimal", "float", "double", "duration"):
        add(p, "anyAtomicType", collapse)
    for p in _TIMES:
        add(p, "anyAtomicType", collapse, Facet("explicitTimezone", ("optional",)))
    for p in ("hexBinary", "base64Binary", "anyURI", "QName", "NOTATION"):
        add(p, "anyAtomicType", collapse)
    add("normalizedString", "string", Facet("whiteSpace", ("replace",)))
    add("token", "normalizedString", Facet("whiteSpace", ("collapse",)))
    add("language", "token", Facet("pattern", ("[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*",)))
    add("NMTOKEN", "token", Facet("pattern", (r"\c+",)))
    add("Name", "token", Facet("pattern", (r"\i\c*",)))
    add("NCName", "Name", Facet("pattern", (r"[\i-[:]][\c-[:]]*",)))
    for p in ("ID", "IDREF", "ENTITY"):
        add(p, "NCName")
    for name, item in (("NMTOKENS", "NMTOKEN"), ("IDREFS", "IDREF"), ("ENTITIES", "ENTITY")):
        out[name] = SimpleType(name, ANY_SIMPLE, "list", item=out[item], facets=(Facet("minLength", ("1",)), Facet("whiteSpace", ("collapse",))))
    add("integer", "decimal", Facet("fractionDigits", ("0",), True), Facet("pattern", (r"[\-+]?[0-9]+",)))
    bounds = {
        "nonPositiveInteger": ("integer", None, 0), "negativeInteger": ("nonPositiveInteger", None, -1), "long": ("integer", -(2**63), 2**63 - 1), "int": ("long", -(2**31), 2**31 - 1), "short": ("int", -(2**15), 2**15 - 1), "byte": ("short", -128, 127),
        "nonNegativeInteger": ("integer", 0, None), "unsignedLong": ("nonNegativeInteger", None, 2**64 - 1), "unsignedInt": ("unsignedLong", None, 2**32 - 1), "unsignedShort": ("unsignedInt", None, 2**16 - 1), "unsignedByte": ("unsignedShort", None, 255), "positiveInteger": ("nonNegativeInteger", 1, None),
    }
    for name, (base, low, high) in bounds.items():
        add(name, base, *([Facet("maxInclusive", (str(high),))] if high is not None else []), *([Facet("minInclusive", (str(low),))] if low is not None else []))
    add("yearMonthDuration", "duration", Facet("pattern", ("[^DT]*",)))
    add("dayTimeDuration", "duration", Facet("pattern", ("[^YM]*(T.*)?",)))
    add("dateTimeStamp", "dateTime", Facet("explicitTimezone", ("required",), True))
    add("precisionDecimal", "anyAtomicType", collapse)
    return out


BUILTINS = _builtins()
