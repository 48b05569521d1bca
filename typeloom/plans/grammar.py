"""The grammar of schema documents: which elements may stand in which, in order.

An element's children are spelled as their names, each followed by a space, and
matched with a regular expression.  What does not match is an error without a
rule, at the first child that cannot stand where it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from ..functions.types import KINDS, XSD
from ..sources.xml_reader import Element

_NOTE = "(?:annotation )?"
_SIMPLE = "(?:simpleType )?"
_FACETS = "(?:(?:%s) )*" % "|".join(sorted((set(KINDS) - {"assertions"}) | {"assertion"}))
_USES = "(?:(?:attribute|attributeGroup) )*(?:anyAttribute )?"
_MODEL = "(?:openContent )?(?:(?:group|all|choice|sequence) )?"
_TYPE = "(?:(?:simpleType|complexType) )?"
_TOP = "simpleType|complexType|group|attributeGroup|element|attribute|notation"
_PARTS = "(?:(?:element|group|choice|sequence|all|any) )*"

GRAMMAR: dict[str, str] = {
    "schema": f"(?:(?:include|import|redefine|override|annotation) )*(?:defaultOpenContent (?:annotation )*)?(?:(?:{_TOP}) (?:annotation )*)*",
    "redefine": "(?:(?:annotation|simpleType|complexType|group|attributeGroup) )*",
    "override": f"(?:(?:annotation|{_TOP}) )*",
    "simpleType": f"{_NOTE}(?:restriction|list|union) ",
    "simpleType/restriction": f"{_NOTE}{_SIMPLE}{_FACETS}",
    "list": f"{_NOTE}{_SIMPLE}",
    "union": f"{_NOTE}(?:simpleType )*",
    "complexType": f"{_NOTE}(?:simpleContent |complexContent |{_MODEL}{_USES}(?:assert )*)",
    "simpleContent": f"{_NOTE}(?:restriction|extension) ",
    "complexContent": f"{_NOTE}(?:restriction|extension) ",
    "simpleContent/restriction": f"{_NOTE}{_SIMPLE}{_FACETS}{_USES}(?:assert )*",
    "simpleContent/extension": f"{_NOTE}{_USES}(?:assert )*",
    "complexContent/restriction": f"{_NOTE}{_MODEL}{_USES}(?:assert )*",
    "complexContent/extension": f"{_NOTE}{_MODEL}{_USES}(?:assert )*",
    "group": f"{_NOTE}(?:(?:all|choice|sequence) )?",
    "all": f"{_NOTE}{_PARTS}",
    "choice": f"{_NOTE}{_PARTS}",
    "sequence": f"{_NOTE}{_PARTS}",
    "attributeGroup": f"{_NOTE}{_USES}",
    "element": f"{_NOTE}{_TYPE}(?:alternative )*(?:(?:unique|key|keyref) )*",
    "attribute": f"{_NOTE}{_SIMPLE}",
    "alternative": f"{_NOTE}{_TYPE}",
    "openContent": f"{_NOTE}(?:any )?",
    "defaultOpenContent": f"{_NOTE}any ",
} | {k: f"{_NOTE}(?:selector (?:field )+)?" for k in ("key", "unique", "keyref")} | {k: _NOTE for k in ("include", "import", "notation", "selector", "field", "any", "anyAttribute", "assert", "assertion", *(set(KINDS) - {"assertions"}))}
_COMPILED = {k: re.compile(v) for k, v in GRAMMAR.items()}


def gate(top: Element, fail: Callable[[str, Element], Exception]) -> None:
    """Raises ``fail(message, element)`` for the first fault, in document order."""
    todo = [(top, "schema")]
    while todo:
        e, kind = todo.pop()
        kids = e.elements()
        for c in kids:
            if c.ns != XSD:
                raise fail(f"{c.local} is no schema element", c)
        pattern = _COMPILED.get(kind)
        if pattern is None:
            raise fail(f"{e.local} is no element of a schema", e)
        names = [f"{c.local} " for c in kids]
        if not pattern.fullmatch("".join(names)):
            # the longest beginning that may stand there ends before the culprit
            good = next((i for i in range(len(names), 0, -1) if _begins(pattern, "".join(names[:i]))), 0)
            if good < len(names):
                raise fail(f"{kids[good].local} cannot stand here in {e.local}", kids[good])
            raise fail(f"{e.local} lacks an element", e)
        todo += [(c, f"{e.local}/{c.local}" if f"{e.local}/{c.local}" in _COMPILED else c.local) for c in reversed(kids) if c.local != "annotation"]


def _begins(pattern: re.Pattern, text: str) -> bool:
    """Can the text be a beginning of what matches?  Patterns here are sequences
    of optional parts, with a required one at most: so it matches alone, or with
    one more element."""
    return pattern.fullmatch(text) is not None or any(pattern.fullmatch(text + more) for more in ("restriction ", "selector field ", "field ", "any "))
