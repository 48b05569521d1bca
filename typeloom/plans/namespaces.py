"""Wildcards: namespace constraints as set algebra, and admission of names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NamespaceConstraint:
    """``any``; the namespaces listed; or all ``but`` those listed.  The absent
    namespace is the empty string."""

    variety: str  # any, enumeration, not
    names: frozenset[str] = frozenset()

    def allows(self, ns: str) -> bool:
        return self.variety == "any" or (ns in self.names) == (self.variety == "enumeration")

    def column(self, ns: Column) -> Column:
        if self.variety == "any":
            return F.lit(True)
        inside = ns.isin(*sorted(self.names)) if self.names else F.lit(False)
        return inside if self.variety == "enumeration" else ~inside


ANY = NamespaceConstraint("any")


def _made(inside: bool, names: frozenset[str]) -> NamespaceConstraint:
    if not inside and not names:
        return ANY
    return NamespaceConstraint("enumeration" if inside else "not", names)


def _as_set(c: NamespaceConstraint) -> tuple[bool, frozenset[str]]:
    """(is it finite, the names in it or missing from it)."""
    return (True, c.names) if c.variety == "enumeration" else (False, c.names if c.variety == "not" else frozenset())


def union(a: NamespaceConstraint, b: NamespaceConstraint) -> NamespaceConstraint:
    (p, x), (q, y) = _as_set(a), _as_set(b)
    if p and q:
        return _made(True, x | y)
    if p or q:
        return _made(False, (y - x) if p else (x - y))
    return _made(False, x & y)


def intersect(a: NamespaceConstraint, b: NamespaceConstraint) -> NamespaceConstraint:
    (p, x), (q, y) = _as_set(a), _as_set(b)
    if p and q:
        return _made(True, x & y)
    if p or q:
        return _made(True, (x - y) if p else (y - x))
    return _made(False, x | y)


def complement(a: NamespaceConstraint) -> NamespaceConstraint:
    p, x = _as_set(a)
    return _made(not p, x)


def difference(a: NamespaceConstraint, b: NamespaceConstraint) -> NamespaceConstraint:
    return intersect(a, complement(b))


def subset(a: NamespaceConstraint, b: NamespaceConstraint) -> bool:
    d = difference(a, b)
    return d.variety == "enumeration" and not d.names


@dataclass(frozen=True)
class Wildcard:
    """A wildcard: its namespaces, names it refuses, and how it processes."""

    constraint: NamespaceConstraint = ANY
    process: str = "strict"
    disallowed: frozenset[tuple[str, str]] = frozenset()
    defined: bool = False  # ##defined
    sibling: bool = False  # ##definedSibling

    def admits(self, name: tuple[str, str], defined: frozenset = frozenset(), siblings: frozenset = frozenset()) -> bool:
        return self.constraint.allows(name[0]) and name not in self.disallowed and not (self.defined and name in defined) and not (self.sibling and name in siblings)

    def column(self, ns: Column, local: Column, defined: frozenset = frozenset(), siblings: frozenset = frozenset()) -> Column:
        """The same as a predicate over a table of names."""
        refused = set(self.disallowed) | (set(defined) if self.defined else set()) | (set(siblings) if self.sibling else set())
        out = self.constraint.column(ns)
        if refused:
            out = out & ~F.concat(F.lit("{"), ns, F.lit("}"), local).isin(*[f"{{{a}}}{b}" for a, b in sorted(refused)])
        return out


def parse(namespace: str | None, not_namespace: str | None, target: str) -> NamespaceConstraint:
    """From the ``namespace`` and ``notNamespace`` attributes."""
    word = lambda w: {"##targetNamespace": target, "##local": ""}.get(w, w)
    if not_namespace is not None:
        return _made(False, frozenset(map(word, not_namespace.split())))
    if namespace is None or namespace.strip() == "##any":
        return ANY
    if namespace.strip() == "##other":
        return _made(False, frozenset((target, "")))
    return _made(True, frozenset(map(word, namespace.split())))


UNBOUNDED = None


@dataclass(frozen=True)
class Occurs:
    """A range of counts; ``high`` is None where it is unbounded."""

    low: int = 1
    high: int | None = 1

    def permits(self, n: int) -> bool:
        return n >= self.low and (self.high is None or n <= self.high)

    def plus(self, o: "Occurs") -> "Occurs":
        return Occurs(self.low + o.low, None if self.high is None or o.high is None else self.high + o.high)

    def times(self, o: "Occurs") -> "Occurs":
        high = 0 if self.high == 0 or o.high == 0 else None if self.high is None or o.high is None else self.high * o.high
        return Occurs(self.low * o.low, high)

    def either(self, o: "Occurs") -> "Occurs":
        return Occurs(min(self.low, o.low), None if self.high is None or o.high is None else max(self.high, o.high))

    def within(self, o: "Occurs") -> bool:
        return self.low >= o.low and (o.high is None or (self.high is not None and self.high <= o.high))

    def column(self, n: Column) -> Column:
        out = n >= self.low
        return out if self.high is None else out & (n <= self.high)
