"""A simple type compiled into Column expressions.

``check`` gives the rule that a literal breaks first, or null: whitespace, then
patterns, then the lexical mapping, then the value facets in effective order.
Everything is native, so a scan, the checks and a count by rule stay in one
generated stage; facet values are constants that the optimiser folds.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V
from .patterns import translate
from .types import Facet, SimpleType


class Undecided(ValueError):
    """A type whose literals have no verdict: nothing governs its mapping."""


def _null() -> Column:
    return F.lit(None).cast("string")


def _bindings(t: SimpleType, given: Column | None) -> Column | None:
    if t.bindings:
        return F.create_map(*[F.lit(x) for kv in t.bindings for x in kv])
    return given


def _pattern(c: Column, f: Facet) -> Column:
    return reduce(or_, [c.rlike(translate(p)) for p in f.values])


def tokens(raw: Column) -> Column:
    return F.filter(F.split(V.white(raw, "collapse"), " "), lambda x: x != "")


def _kind(t: SimpleType) -> str:
    kind = t.primitive()
    if kind is None:
        raise Undecided(t.name or "an anonymous type")
    return kind


def _measure(c: Column, t: SimpleType, raw: Column) -> Column | None:
    """Length in characters, octets or items; None where lengths never fail."""
    if t.variety == "list":
        return F.size(tokens(raw))
    kind = _kind(t)
    if kind in ("QName", "NOTATION"):
        return None
    return V.octets(c, kind) if kind in ("hexBinary", "base64Binary") else F.length(c)


def key(raw: Column, t: SimpleType, bindings: Column | None = None) -> Column:
    """A string that equal values share, whatever type they came by; null for
    what is invalid or equals nothing."""
    if t.variety == "list":
        item = t.item
        parts = F.transform(tokens(raw), lambda x: key(x, item, bindings))
        return F.when(F.exists(parts, lambda x: x.isNull()), _null()).otherwise(F.concat(F.lit("["), F.array_join(parts, "\x1f"), F.lit("]")))
    if t.variety == "union":
        if not t.members:
            return _null()
        return F.coalesce(*[F.when(check(raw, m, bindings).isNull(), key(raw, m, bindings)) for m in t.members])
    kind = _kind(t)
    c = V.white(raw, t.white_space())
    family = {"yearMonthDuration": "duration", "dayTimeDuration": "duration", "dateTimeStamp": "dateTime"}.get(kind, kind)
    any_ = F.when(V.ok(c, kind, bindings), F.concat(F.lit(family + ":"), V.eq_key(c, kind, bindings)))
    # digits as a whole number is written are their own key
    return F.when(raw.rlike(r"\A[1-9][0-9]*\z"), F.concat(F.lit("decimal:"), raw)).otherwise(any_) if kind == "decimal" else any_


def canonical(raw: Column, t: SimpleType) -> Column:
    """The canonical form; null for invalid literals and values without one."""
    if t.variety == "list":
        item = t.item
        return F.array_join(F.transform(tokens(raw), lambda x: canonical(x, item)), " ")
    if t.variety == "union":
        return F.coalesce(*[F.when(check(raw, m).isNull(), canonical(raw, m)) for m in t.members]) if t.members else _null()
    kind = _kind(t)
    c = V.white(raw, t.white_space())
    return F.when(V.ok(c, kind), V.canonical(c, kind))


def _value_facet(f: Facet, owner: SimpleType, t: SimpleType, raw: Column, c: Column, bindings: Column | None) -> Column | None:
    """True where the literal breaks the facet; None for one that cannot fail."""
    v = f.values[0]
    if f.kind in ("whiteSpace", "pattern", "assertions"):
        return None
    if f.kind == "enumeration":
        space = owner.base if owner.base is not None and owner.variety != "atomic" and not owner.derives_from(t.name or "") else owner
        plain = SimpleType(owner.name, space.base, t.variety, t.item, t.members) if t.variety != "atomic" else t
        allowed = [key(F.lit(x), plain, _bindings(owner, bindings)) for x in f.values]
        same = reduce(or_, [F.coalesce(key(raw, plain, bindings) == a, F.lit(False)) for a in allowed])
        if t.variety == "atomic" and _kind(t) in ("float", "double", "precisionDecimal") and any(V.white_text(x, "collapse") == "NaN" for x in f.values):
            same = same | (c == "NaN")  # not equal to itself, but identical
        return ~same
    if f.kind in ("length", "minLength", "maxLength"):
        n = _measure(c, t, raw)
        if n is None:
            return None
        return {"length": n != int(v), "minLength": n < int(v), "maxLength": n > int(v)}[f.kind]
    kind = _kind(t)
    if f.kind in ("minInclusive", "minExclusive", "maxInclusive", "maxExclusive"):
        way = V.compare(c, V.white_text(v, "collapse"), kind)
        good = {"minInclusive": way >= 0, "minExclusive": way > 0, "maxInclusive": way <= 0, "maxExclusive": way < 0}[f.kind]
        return ~F.coalesce(good, F.lit(False))  # incomparable is a failure
    if f.kind == "totalDigits":
        return (V.precision_total(c) if kind == "precisionDecimal" else V.total_digits(c)) > int(v)
    if f.kind == "fractionDigits":
        return V.fraction_digits(c) > int(v)
    if f.kind == "explicitTimezone":
        zoned = c.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})$") if kind != "gYear" else c.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})$")
        return {"required": ~zoned, "prohibited": zoned}.get(v)
    if f.kind in ("maxScale", "minScale"):
        scale = V.scientific(c)[2]
        special = c.endswith("INF") | (c == "NaN")
        return ~special & ((scale > int(v)) if f.kind == "maxScale" else (scale < int(v)))
    raise ValueError(f.kind)


def check(raw: Column, t: SimpleType, bindings: Column | None = None) -> Column:
    """The first rule that a literal breaks, or null.  A null literal has no
    verdict and gives null."""
    if t.variety == "atomic" and _kind(t) not in ("string", "anyURI", "boolean", "decimal", "hexBinary", "base64Binary", "QName", "NOTATION"):
        return F.when(raw.isNotNull(), V.let(V.white(raw, t.white_space()), lambda c: _chain(raw, c, t, bindings)))
    if t.variety == "union":
        return F.when(raw.isNotNull(), _union(raw, t, bindings))
    return F.when(raw.isNotNull(), _chain(raw, V.white(raw, t.white_space()), t, bindings))


def _rule(kind: str) -> Column:
    return F.lit(f"cvc-{kind}-valid")


def _first(steps: list[tuple[Column, Column]]) -> Column:
    """The name of the first step that is broken."""
    out = None
    for broken, name in steps:
        out = F.when(broken, name) if out is None else out.when(broken, name)
    return _null() if out is None else out


def _value_steps(raw: Column, c: Column, t: SimpleType, bindings: Column | None) -> list[tuple[Column, Column]]:
    made = ((_value_facet(f, owner, t, raw, c, bindings), f.kind) for f, owner in t.effective())
    return [(broken, _rule(kind)) for broken, kind in made if broken is not None]


def _chain(raw: Column, c: Column, t: SimpleType, bindings: Column | None) -> Column:
    steps = [(~_pattern(c, f), _rule("pattern")) for f, _ in t.effective() if f.kind == "pattern"]
    if t.variety == "list":
        item = t.item
        bad = F.filter(F.transform(tokens(raw), lambda x: check(x, item, bindings)), lambda x: x.isNotNull())
        steps.append((F.size(bad) > 0, F.get(bad, 0)))
    else:
        steps.append((~F.coalesce(V.ok(c, _kind(t), bindings), F.lit(False)), _rule("datatype")))
    return _first(steps + _value_steps(raw, c, t, bindings))


def _union(raw: Column, t: SimpleType, bindings: Column | None) -> Column:
    if not t.members:
        return _rule("datatype")
    modes = [m.white_space() if m.variety != "union" else "preserve" for m in t.members]
    active = F.coalesce(*[F.when(check(raw, m, bindings).isNull(), F.lit(i)) for i, m in enumerate(t.members)])

    def own(i: Column) -> Column:
        # the winner's whitespace is what the union's own patterns see
        seen = V.white(raw, modes[0])
        for k, mode in enumerate(modes[1:], 1):
            seen = F.when(i == k, V.white(raw, mode)).otherwise(seen)
        steps = [(i.isNull(), _rule("datatype"))] + [(~_pattern(seen, f), _rule("pattern")) for f, _ in t.effective() if f.kind == "pattern"]
        return _first(steps + _value_steps(raw, seen, t, bindings))

    return V.let(active, own)


def verdict(raw: Column, t: SimpleType, bindings: Column | None = None) -> Column:
    """``STRUCT<ok, rule, canonical>``."""
    return V.let(check(raw, t, bindings), lambda rule: F.struct(rule.isNull().alias("ok"), rule.alias("rule"), F.when(rule.isNull(), canonical(raw, t)).alias("canonical")))


def matches_fixed(raw: Column, fixed: str, t: SimpleType, bindings: Column | None = None) -> Column:
    """Does a literal agree with a fixed value?  Null where it is undecided."""
    a, b = key(raw, t, bindings), key(F.lit(fixed), t, bindings)
    nan = (V.white(raw, "collapse") == "NaN") & (F.lit(V.white_text(fixed, "collapse")) == "NaN")
    return F.when(nan, F.lit(True)).otherwise(a == b)
