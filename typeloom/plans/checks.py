"""Checks on a compiled schema, in a fixed order: the first failure is raised."""

from __future__ import annotations

from ..functions.types import SimpleType
from .content import Declined, ambiguous, automaton, included
from .model import ANY_TYPE, ComplexType, ElementDecl, Group, Particle, QName, Schema, SchemaError


def complex_types(schema: Schema) -> list[ComplexType]:
    """All complex types, anonymous ones included, each once."""
    out: list[ComplexType] = []
    todo: list = [*schema.types.values(), *[e.type for e in schema.elements.values()]]
    while todo:
        t = todo.pop(0)
        if not isinstance(t, ComplexType) or t is ANY_TYPE or any(t is x for x in out):
            continue
        out.append(t)
        todo += [e.type for e in elements(t.particle)] + [t.base]
    return out


def elements(p: Particle | None) -> list[ElementDecl]:
    if p is None:
        return []
    if isinstance(p.term, ElementDecl):
        return [p.term]
    if isinstance(p.term, Group):
        return [e for q in p.term.particles for e in elements(q)]
    return []


def check(schema: Schema) -> None:
    _bases(schema)
    _substitution(schema)
    types = complex_types(schema)
    for t in types:
        _consistent(schema, t)
    for t in types:
        name = ambiguous(t, schema)
        if name:
            raise SchemaError("cos-nonambig", f"{name} has two particles", t.where)
    for t in types:
        _derivation(schema, t)
    for e in schema.elements.values():
        for alt in e.alternatives:
            if not schema.substitutable(alt.type, e.type) and getattr(alt.type, "name", None) != "error":
                raise SchemaError("e-props-correct", f"an alternative of {e.name[1]} is not derived from its type", e.where)
    for c in schema.constraints.values():
        if c.kind == "keyref":
            if c.refer is None or c.refer not in schema.constraints:
                raise SchemaError("src-resolve", f"{c.name[1]} refers to no key")
            target = schema.constraints[c.refer]
            if target.kind == "keyref" or len(target.fields) != len(c.fields):
                raise SchemaError("c-props-correct", f"{c.name[1]} and {target.name[1]} do not fit")
    from .literals import check_literal

    for t in types:
        for a in t.attributes.values():
            v = a.fixed if a.fixed is not None else a.default
            if v is not None and check_literal(v, a.type) is not None:
                raise SchemaError("a-props-correct", f"the value constraint of {a.name[1]} is not valid", t.where)
    for e in [*schema.elements.values(), *[x for t in types for x in elements(t.particle)]]:
        v = e.fixed if e.fixed is not None else e.default
        s = e.type if isinstance(e.type, SimpleType) else (e.type.simple if e.type.variety == "simple" else None)
        if v is not None:
            if s is None and e.type.variety != "mixed":
                raise SchemaError("e-props-correct", f"a value constraint on {e.name[1]}, which has no text", e.where)
            if s is not None and check_literal(v, s) is not None:
                raise SchemaError("e-props-correct", f"the value constraint of {e.name[1]} is not valid", e.where)


def _bases(schema: Schema) -> None:
    for n, t in schema.types.items():
        seen, x = [], t
        while isinstance(x, ComplexType) and x is not ANY_TYPE:
            if any(x is y for y in seen):
                raise SchemaError("ct-props-correct", f"{n[1]} is its own base", t.where)
            seen.append(x)
            x = x.base


def _substitution(schema: Schema) -> None:
    for n, e in schema.elements.items():
        for h in e.heads:
            if h not in schema.elements:
                continue  # a head that is not declared is tolerated
            head = schema.elements[h]
            if not schema.substitutable(e.type, head.type, head.final):
                raise SchemaError("e-props-correct", f"{n[1]} cannot substitute for {h[1]}", e.where)
        seen: set[QName] = set()
        todo = list(e.heads)
        while todo:
            h = todo.pop()
            if h == n:
                raise SchemaError("e-props-correct", f"{n[1]} substitutes for itself", e.where)
            if h not in seen and h in schema.elements:
                seen.add(h)
                todo += schema.elements[h].heads


def _consistent(schema: Schema, t: ComplexType) -> None:
    seen: dict[QName, object] = {}
    for e in elements(t.particle):
        for x in schema.members(e.name) if e.is_global and e.name in schema.elements else [e]:
            if x.name in seen and seen[x.name] is not x.type and seen[x.name] != x.type:
                raise SchemaError("cos-element-consistent", f"{x.name[1]} has two types in one model")
            seen[x.name] = x.type


def _subsumes(schema: Schema, e: ElementDecl, base: ElementDecl) -> str | None:
    """What a restriction's element may do that the base's may not; None for nothing."""
    if e.nillable and not base.nillable:
        return "it is nillable"
    if base.fixed is not None and e.fixed != base.fixed:
        return "its value was fixed"
    if not {c.name for c in base.constraints} <= {c.name for c in e.constraints}:
        return "it lacks a constraint"
    if not base.block <= e.block:
        return "it blocks less"
    way = schema.derivation(e.type, base.type)
    if way is None or (base.type is not ANY_TYPE and "extension" in way):
        return "its type is no restriction of the base's"
    return None


def _derivation(schema: Schema, t: ComplexType) -> None:
    b = t.base
    if not isinstance(b, ComplexType) or b is ANY_TYPE or t.derivation != "restriction":
        return
    if t.variety == "mixed" and b.variety == "element-only":
        raise SchemaError("derivation-ok-restriction", "mixed restricts element-only", t.where)
    if t.variety == "simple":
        return
    try:
        inside = included(automaton(t, schema), automaton(b, schema))
    except Declined:
        return  # too large, or without a verdict: accepted
    if not inside:
        raise SchemaError("derivation-ok-restriction", "the content is not a subset of the base's", t.where)
    general = {e.name: e for e in elements(b.particle)}
    for e in elements(t.particle):
        if e.name in general and (why := _subsumes(schema, e, general[e.name])):
            raise SchemaError("derivation-ok-restriction", f"{e.name[1]}: {why}", t.where)
