"""Positioned XML reading: namespaces, encodings, well-formedness.

One reader serves schema documents on the driver and instance documents on
executors.  Comments, processing instructions and declarations are dropped;
entity declarations are refused, so nothing expands.
"""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass, field
from xml.parsers import expat

XML_NS = "http://www.w3.org/XML/1998/namespace"
XMLNS = "http://www.w3.org/2000/xmlns/"
XSI = "http://www.w3.org/2001/XMLSchema-instance"
_DECLARED = re.compile(r"""^<\?xml[^>]*?encoding\s*=\s*["']([A-Za-z0-9._-]+)["']""")


class XmlError(ValueError):
    """Rule ``xml-wf`` at a line and column."""

    rule = "xml-wf"

    def __init__(self, message: str, line: int = 0, column: int = 0):
        super().__init__(f"{line}:{column}: [xml-wf] {message}")
        self.message, self.line, self.column = message, line, column


@dataclass
class Attr:
    ns: str
    local: str
    value: str
    prefix: str = ""


@dataclass
class Text:
    data: str
    line: int
    column: int


@dataclass
class Element:
    ns: str
    local: str
    attrs: list[Attr]
    bindings: dict[str, str]
    line: int
    column: int
    parent: "Element | None" = None
    children: list["Element | Text"] = field(default_factory=list)
    base: str = ""

    def get(self, local: str, default: str | None = None) -> str | None:
        return next((a.value for a in self.attrs if a.ns == "" and a.local == local), default)

    def elements(self, *locals_: str) -> list["Element"]:
        return [c for c in self.children if isinstance(c, Element) and (not locals_ or c.local in locals_)]

    def text(self) -> str:
        return "".join(c.data for c in self.children if isinstance(c, Text))

    def resolve(self, qname: str) -> tuple[str, str] | None:
        """(namespace, local) of a QName here; None where its prefix is unbound."""
        prefix, colon, local = qname.strip().rpartition(":")
        ns = self.bindings.get(prefix, "" if not colon else None)
        return None if ns is None else (ns, local)


def decode(data: bytes) -> str:
    """Text of UTF-8 or UTF-16 data; a declaration must agree with the mark."""
    if data.startswith(codecs.BOM_UTF8):
        text, found = data[3:].decode("utf-8"), "utf-8"
    elif data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        text, found = data.decode("utf-16"), "utf-16"
    else:
        try:
            text, found = data.decode("utf-8"), "utf-8"
        except UnicodeDecodeError as e:
            raise XmlError(f"not UTF-8: {e.reason}") from None
    m = _DECLARED.match(text)
    if m:
        name = m[1].lower()
        if name in ("utf-8", "us-ascii", "ascii") and found == "utf-8":
            pass
        elif name in ("utf-16", "utf-16le", "utf-16be") and found == "utf-16":
            pass
        else:
            raise XmlError(f"encoding {m[1]} disagrees with the data or is not supported")
    return text


def source(data: bytes | str) -> str:
    """The text to parse: decoded, and without what a declaration says of bytes."""
    text = decode(data) if isinstance(data, bytes) else data.removeprefix("﻿")
    return re.sub(r"^(<\?xml[^>]*?)\s+encoding\s*=\s*(\"[^\"]*\"|'[^']*')", r"\1", text)


def read(data: bytes | str) -> Element:
    """The root of a document, or XmlError."""
    text = source(data)
    p = expat.ParserCreate("utf-8")
    p.ordered_attributes = True
    p.buffer_text = False
    now: list[Element] = []
    root: list[Element] = []

    def where() -> tuple[int, int]:
        return p.CurrentLineNumber, p.CurrentColumnNumber + 1

    def fail(message: str):
        raise XmlError(message, *where())

    def start(name: str, raw: list[str]) -> None:
        line, column = where()
        parent = now[-1] if now else None
        bindings = parent.bindings if parent else {"xml": XML_NS}
        pairs = list(zip(raw[::2], raw[1::2]))
        own = {}
        for k, v in pairs:
            if k == "xmlns":
                own[""] = v
            elif k.startswith("xmlns:"):
                prefix = k[6:]
                if not v:
                    fail(f"prefix {prefix} is bound to nothing")
                if prefix == "xmlns" or (prefix == "xml") != (v == XML_NS):
                    fail(f"prefix {prefix} cannot be bound so")
                own[prefix] = v
        if own:
            bindings = {k: v for k, v in (bindings | own).items() if v}

        def expand(q: str, attribute: bool) -> tuple[str, str, str]:
            prefix, colon, local = q.partition(":")
            if not colon:
                return ("" if attribute else bindings.get("", "")), q, ""
            if ":" in local or not prefix or not local:
                fail(f"{q} is no qualified name")
            if prefix not in bindings:
                fail(f"prefix {prefix} is not bound")
            return bindings[prefix], local, prefix

        ns, local, _ = expand(name, False)
        attrs, seen = [], set()
        for k, v in pairs:
            if k == "xmlns" or k.startswith("xmlns:"):
                continue
            ans, alocal, prefix = expand(k, True)
            if (ans, alocal) in seen:
                fail(f"attribute {k} twice")
            seen.add((ans, alocal))
            attrs.append(Attr(ans, alocal, v, prefix))
        e = Element(ns, local, attrs, bindings, line, column, parent)
        if parent:
            parent.children.append(e)
        else:
            root.append(e)
        now.append(e)

    def end(_: str) -> None:
        now.pop()

    def data_(s: str) -> None:
        if now:
            e = now[-1]
            if e.children and isinstance(e.children[-1], Text):
                e.children[-1].data += s
            else:
                e.children.append(Text(s, *where()))

    def entity(*_) -> None:
        fail("an entity declaration")

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.EntityDeclHandler = start, end, data_, entity
    try:
        p.Parse(text.encode("utf-8"), True)
    except expat.ExpatError as e:
        raise XmlError(expat.ErrorString(e.code), e.lineno, e.offset + 1) from None
    except UnicodeEncodeError as e:
        raise XmlError(f"not a character: {e.reason}") from None
    return root[0]
