"""Conditional type assignment: tests over attributes as Column expressions.

The grammar is that of the schema language's test subset.  What lies outside it,
or needs a type this engine does not compare, is declined.  Errors are nulls, and
the three-valued logic of SQL is then just the one that is asked for; at the top
a null counts as false.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.facets import check
from ..functions.types import BUILTINS, XSD, SimpleType
from ..plans.model import XPath

FN = "http://www.w3.org/2005/xpath-functions"
NUMERIC = ("decimal", "integer", "float", "double")


class Declined(ValueError):
    """A test that gets no verdict."""


class StaticError(ValueError):
    """err:XPST0081: a prefix that is not bound."""

    rule = "err:XPST0081"


_TOKEN = re.compile(r"\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<str>\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*')|(?P<op>!=|<=|>=|::|[=<>()@,:*?])|(?P<name>[^\W\d][\w.\-]*)|(?P<bad>\S))")


def lex(text: str) -> list[tuple[str, str]]:
    out, depth, i, plain = [], 0, 0, []
    quote = ""
    while i < len(text):  # comments nest, and are not comments inside strings
        if quote:
            quote = "" if text[i] == quote else quote
        elif text.startswith("(:", i):
            depth, i = depth + 1, i + 2
            continue
        elif depth and text.startswith(":)", i):
            depth, i = depth - 1, i + 2
            plain.append(" ")
            continue
        elif not depth and text[i] in "\"'":
            quote = text[i]
        if not depth:
            plain.append(text[i])
        i += 1
    if depth or quote:
        raise Declined("an unclosed comment or string")
    body = "".join(plain).strip()
    at = 0
    while at < len(body):
        m = _TOKEN.match(body, at)
        if not m or m["bad"]:
            raise Declined(f"unexpected text at {at}")
        kind = m.lastgroup
        out.append((kind, m[kind]))
        at = m.end()
    return out


@dataclass
class Value:
    """Items: attribute values (untyped), one literal, or a cast of one.  ``kind``
    is a builtin's name or "untyped"; ``item`` makes the literal of an item."""

    kind: str
    items: Column  # array<string>
    error: Column | None = None  # true where evaluating it is an error
    attribute: bool = False


class Parser:
    """``attrs`` is a column ``array<struct<name, value>>`` of the element."""

    def __init__(self, test: XPath, attrs: Column, types: dict | None = None):
        self.tokens, self.at = lex(test.expression), 0
        self.test, self.attrs, self.types = test, attrs, types or {(XSD, n): t for n, t in BUILTINS.items()}

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("", "")

    def take(self, value: str) -> bool:
        if self.peek()[1] == value and self.peek()[0] in ("op", "name"):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise Declined(f"{value} expected")

    def parse(self) -> Column:
        out = self.either()
        if self.at < len(self.tokens):
            raise Declined("trailing tokens")
        return F.coalesce(out, F.lit(False))

    def either(self) -> Column:
        out = self.both()
        while self.take("or"):
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.boolean()
        while self.take("and"):
            out = out & self.boolean()
        return out

    def qname(self, attribute: bool = False) -> tuple[str, str]:
        kind, first = self.peek()
        if kind != "name":
            raise Declined("a name expected")
        self.at += 1
        if self.peek()[1] == ":" and self.peek(1)[0] == "name":
            self.at += 1
            local = self.peek()[1]
            self.at += 1
            if first not in self.test.bindings:
                raise StaticError(f"prefix {first} is not bound")
            return self.test.bindings[first], local
        return "" if attribute else None, first

    def boolean(self) -> Column:
        kind, value = self.peek()
        if value == "(" and kind == "op":
            save = self.at
            self.at += 1
            out = self.either()
            self.need(")")
            if self.peek()[1] in ("=", "!=", "<", "<=", ">", ">="):
                self.at = save
            else:
                return out
        if kind == "name" and self._is_not():
            self.need("(")
            inner = self.either()
            self.need(")")
            return ~inner
        left = self.value()
        op = self.peek()[1]
        if self.peek()[0] == "op" and op in ("=", "!=", "<", "<=", ">", ">="):
            self.at += 1
            return self.compare(op, left, self.value())
        return self.effective(left)

    def _is_not(self) -> bool:
        save = self.at
        try:
            ns, local = self.qname()
        except Declined:
            self.at = save
            return False
        if local == "not" and ns in (None, FN) and self.peek()[1] == "(":
            return True
        self.at = save
        return False

    def value(self) -> Value:
        out = self.simple()
        while self.peek() == ("name", "cast"):
            self.at += 1
            self.need("as")
            name = self.qname()
            optional = self.take("?")
            out = self.cast(out, name, optional)
        return out

    def simple(self) -> Value:
        kind, value = self.peek()
        if kind == "num":
            self.at += 1
            name = "double" if re.search("[eE]", value) else ("decimal" if "." in value else "integer")
            return Value(name, F.array(F.lit(value)))
        if kind == "str":
            self.at += 1
            q = value[0]
            return Value("string", F.array(F.lit(value[1:-1].replace(q * 2, q))))
        if self.take("@") or (self.peek() == ("name", "attribute") and self.peek(1)[1] == "::"):
            if self.peek() == ("name", "attribute"):
                self.at += 2
            return self.attribute()
        if self.take("("):
            out = self.value()
            self.need(")")
            return out
        if kind == "name":
            name = self.qname()
            if self.take("("):
                arg = self.value()
                self.need(")")
                return self.cast(arg, (name[0] if name[0] is not None else XSD, name[1]), True)
        raise Declined("a value expected")

    def attribute(self) -> Value:
        if self.take("*"):
            if self.take(":"):
                local = self.peek()[1]
                self.at += 1
                test = lambda a: F.regexp_replace(a["name"], r"^\{.*\}", "") == local
            else:
                test = lambda a: F.lit(True)
        elif self.peek()[0] == "name" and self.peek(1)[1] == ":" and self.peek(2)[1] == "*":
            prefix = self.peek()[1]
            self.at += 3
            if prefix not in self.test.bindings:
                raise StaticError(f"prefix {prefix} is not bound")
            ns = self.test.bindings[prefix]
            test = lambda a: a["name"].startswith("{" + ns + "}")
        else:
            ns, local = self.qname(True)
            name = f"{{{ns}}}{local}" if ns else local
            test = lambda a: a["name"] == name
        return Value("untyped", F.transform(F.filter(self.attrs, test), lambda a: a["value"]), attribute=True)

    def cast(self, v: Value, name: tuple, optional: bool) -> Value:
        t = self.types.get((name[0] if name[0] is not None else self.test.default, name[1]))
        if not isinstance(t, SimpleType):
            raise Declined("a cast to no simple type")
        if t.variety != "atomic" or t.primitive() in (None, "QName", "NOTATION"):
            raise Declined("a cast to this type")
        n = F.size(v.items)
        bad = n > 1 if optional else n != 1
        bad = bad | F.exists(v.items, lambda x: check(x, t).isNotNull())
        error = bad if v.error is None else (v.error | bad)
        kind = t.primitive()
        return Value("integer" if t.derives_from("integer") else kind, v.items, error)

    # evaluation ----------------------------------------------------------

    def compare(self, op: str, a: Value, b: Value) -> Column:
        kind = self.common(a.kind, b.kind, op)
        test = {"=": lambda c: c == 0, "!=": lambda c: c != 0, "<": lambda c: c < 0, "<=": lambda c: c <= 0, ">": lambda c: c > 0, ">=": lambda c: c >= 0}[op]

        def pair(x: Column, y: Column) -> Column:
            if kind == "string":
                return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
            x, y = (V.white(v, "collapse") for v in (x, y))
            good = V.ok(x, kind) & V.ok(y, kind)
            if kind == "boolean":
                p, q = (v.isin("true", "1").cast("int") for v in (x, y))
                return F.when(good, test(p - q))
            if kind in ("hexBinary", "base64Binary"):
                return F.when(good, (V.canonical(x, kind) == V.canonical(y, kind)) == F.lit(op == "="))
            way = V.compare(x, y, kind)
            nan = F.lit(op == "!=")
            return F.when(good, F.coalesce(test(way), nan))

        out = F.exists(a.items, lambda x: F.exists(b.items, lambda y: pair(x, y)))
        for v in (a, b):
            if v.error is not None:
                out = F.when(~v.error, out)
        return out

    def common(self, a: str, b: str, op: str) -> str:
        """The type in which two operands compare, or Declined."""
        if a == b == "untyped":
            return "string"
        if "untyped" in (a, b):
            other = b if a == "untyped" else a
            if other == "float":
                raise Declined("an attribute against a float")
            return "double" if other in NUMERIC else ("string" if other in ("string", "anyURI") else other)
        if a in NUMERIC and b in NUMERIC:
            if {"float", "double"} <= {a, b}:
                raise Declined("a float against a double")
            return next((k for k in ("double", "float") if k in (a, b)), "decimal")
        if {a, b} <= {"string", "anyURI"}:
            return "string"
        if a != b:
            raise Declined(f"{a} against {b}")
        if op not in ("=", "!=") and a in ("hexBinary", "base64Binary", "duration", "gYear", "gMonth", "gDay", "gYearMonth", "gMonthDay"):
            raise Declined(f"{a} has no order here")
        return a

    def effective(self, v: Value) -> Column:
        if v.attribute:
            return F.size(v.items) > 0
        x = F.get(v.items, 0)
        c = V.white(x, "collapse")
        if v.kind in ("string", "anyURI", "untyped"):
            out = F.coalesce(F.length(x) > 0, F.lit(False))
        elif v.kind in NUMERIC:
            n = V.floating(c, "double")
            out = F.coalesce((n != 0) & (c != "NaN"), F.lit(False))
        elif v.kind == "boolean":
            out = F.coalesce(c.isin("true", "1"), F.lit(False))
        else:
            out = F.lit(None).cast("boolean")
        return out if v.error is None else F.when(~v.error, out)


def compile_test(test: XPath, attrs: Column, types: dict | None = None) -> Column:
    """A boolean column, never null.  Raises Declined or StaticError."""
    return Parser(test, attrs, types).parse()


def select_type(alternatives: list[tuple[XPath | None, str]], default: str, attrs: Column, types: dict | None = None) -> Column:
    """The name of the first alternative whose test holds, else the default.  A
    test that is declined withholds the answer unless one before it holds."""
    cases: list[tuple[Column, Column]] = []
    for test, name in alternatives:
        if test is None:
            cases.append((F.lit(True), F.lit(name)))
            continue
        try:
            cases.append((compile_test(test, attrs, types), F.lit(name)))
        except Declined:
            cases.append((F.lit(True), F.lit(None).cast("string")))
            break
    out = F.lit(default)
    for when, name in reversed(cases):
        out = F.when(when, name).otherwise(out)
    return out
