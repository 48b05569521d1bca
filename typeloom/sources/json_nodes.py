"""JSON documents as a table of nodes, for a schema.

A member is a child element by its local name, or else an attribute of it; the
element wins where a type has both.  A scalar is simple content, an array
repeats its member, null is xsi:nil.  ``$type`` names the type as xsi:type does,
``$xmlns`` binds prefixes for it.  A member that the type does not know becomes
a child without a namespace, which its content model then rejects.  Numbers keep
the digits that they are written with.

What the schema says of names is a table of types, which travels with the task;
a document is read whole and its nodes leave in batches.  One that is not JSON,
or has no object at its top, is one row with rule ``json-wf``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checks import elements
from ..plans.model import ComplexType, QName, Schema
from .xml_nodes import BATCH, NODES, SCHEMA, XSI, qname

_TYPE, _NIL = f"{{{XSI}}}type", f"{{{XSI}}}nil"


class Names:
    """For each type its children and attributes by local name, by number."""

    def __init__(self, schema: Schema, root: QName):
        self.types: list = []
        self.children: list[dict[str, tuple[str, int]]] = []
        self.attributes: list[dict[str, str]] = []
        self.named: dict[str, int] = {}
        self.root = (qname(*root), self._type(schema.elements[root].type))
        for name, t in schema.types.items():
            self.named[qname(*name)] = self._type(t)
        done = 0
        while done < len(self.types):
            t = self.types[done]
            kids: dict[str, tuple[str, int]] = {}
            if isinstance(t, ComplexType):
                for e in elements(t.particle):
                    for m in schema.members(e.name) if e.is_global and e.name in schema.elements else [e]:
                        kids.setdefault(m.name[1], (qname(*m.name), self._type(m.type)))
            self.children.append(kids)
            self.attributes.append({n[1]: qname(*n) for n in t.attributes if n[1] not in kids} if isinstance(t, ComplexType) else {})
            done += 1
        # a type that does not derive from the declared one is refused, so it does not govern
        self.below = [{i for i in self.named.values() if schema.derivation(self.types[i], t) is not None} for t in self.types]
        del self.types

    def _type(self, t) -> int:
        for i, x in enumerate(self.types):
            if x is t:
                return i
        self.types.append(t)
        return len(self.types) - 1


def _text(v) -> str:
    return ("true" if v else "false") if isinstance(v, bool) else str(v)


def rows(names: Names, doc_id: str | None, text: str | bytes | None) -> list[tuple]:
    """Node rows of one document; none of a null."""
    if text is None:
        return []
    try:
        top = json.loads(text, parse_int=str, parse_float=str, parse_constant=lambda c: c)
        if not isinstance(top, dict):
            raise ValueError("no object at the top")
    except (ValueError, RecursionError) as e:
        return [(doc_id, "json-wf", str(e), *[None] * 17)]
    out: list[list] = []
    # (name, value, type, parent, depth, place, path, ups, bindings), or the number of a node that ends
    stack: list = [(names.root[0], top, names.root[1], None, 0, 0, [], [], {})]
    while stack:
        x = stack.pop()
        if isinstance(x, int):
            out[x][5] = len(out) - 1
            continue
        name, value, kind, parent, depth, sib, path, ups, bindings = x
        me, attrs, kids, words, step = len(out), [], [], "", name
        if isinstance(value, dict):
            bindings = bindings | {str(k): str(v) for k, v in value.get("$xmlns", {}).items()} if isinstance(value.get("$xmlns"), dict) else bindings
            asked = value.get("$type")
            if isinstance(asked, str):
                prefix, colon, local = asked.rpartition(":")
                full = qname(bindings.get(prefix, ""), local)
                attrs.append({"name": _TYPE, "value": asked})
                step = f"{name}#{full}"
                if names.named.get(full) in (names.below[kind] if kind >= 0 else ()):
                    kind = names.named[full]
            known, own = (names.children[kind], names.attributes[kind]) if kind >= 0 else ({}, {})
            for k, v in value.items():
                if k in ("$type", "$xmlns"):
                    continue
                if k in known or k not in own or isinstance(v, (dict, list)):
                    child = known.get(k, (k, -1))
                    kids += [(child, one) for one in (v if isinstance(v, list) else [v])]
                elif v is not None:
                    attrs.append({"name": own[k], "value": _text(v)})
        elif value is None:
            attrs.append({"name": _NIL, "value": "true"})
        elif isinstance(value, list):  # an array in an array repeats nothing
            kids = [((name, kind), one) for one in value]
        else:
            words = _text(value)
        here, below = [*path, step], [*ups, me]
        out.append([doc_id, None, None, me, parent, me, depth, sib, name, attrs, words, words != "", not words.strip(" \t\r\n"), len(kids), list(bindings.items()), here, None, None, [c[0] for c, _ in kids], ups])
        stack.append(me)
        for i in range(len(kids) - 1, -1, -1):
            (child, t), one = kids[i]
            stack.append((child, one, t, me, depth + 1, i, here, below, bindings))
    return [tuple(r) for r in out]


def _shred(names: Names):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for part in parts:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                held += rows(names, doc_id, text.as_py())
                if len(held) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), SCHEMA)], schema=SCHEMA)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), SCHEMA)], schema=SCHEMA)

    return run


def shred_json(df: DataFrame, doc_id: str, text: str, schema: Schema, root: QName) -> DataFrame:
    """The nodes of a column of JSON documents whose top is the element ``root``."""
    return df.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_shred(Names(schema, root)), NODES)
