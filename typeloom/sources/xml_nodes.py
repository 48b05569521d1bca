"""XML documents as a table of nodes.

One row per element, made where the element ends, so only what is open is held:
a document is parsed in parts and its rows leave in batches.  One that is longer
than ``WHOLE`` is parsed twice, as its rows must not leave before it is known to
be well-formed; a shorter one's rows wait for its end.  A document that is not well-formed is
one row with rule ``xml-wf``.  A node carries the names on its path with their
``xsi:type``, so that typing needs no join: it is a fold over that array; and the
names of its children, so that content models need none either.  ``ups`` are the
numbers of its ancestors from the root down, so that what lies below a node is
found by an equal number, not by a range.

Plain documents are shredded many at a time (``xml_plain``), all others by the
parser; who reads the nodes says which columns are made.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from .xml_plain import shred_plain, text_bytes
from .xml_reader import XML_NS, XSI, XmlError, source

NODES = (
    "doc_id string, rule string, message string, node_id long, parent_id long, last_id long, depth int, sib int, name string, "
    "attrs array<struct<name: string, value: string>>, text string, has_text boolean, blank boolean, n_children int, bindings map<string, string>, "
    "path array<string>, line int, column int, children array<string>, ups array<long>"
)
_XSI_TYPE = f"{{{XSI}}}type"
_STRINGS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
SCHEMA = pa.schema(
    [
        ("doc_id", pa.string()), ("rule", pa.string()), ("message", pa.string()), ("node_id", pa.int64()), ("parent_id", pa.int64()), ("last_id", pa.int64()), ("depth", pa.int32()), ("sib", pa.int32()), ("name", pa.string()),
        ("attrs", _STRINGS), ("text", pa.string()), ("has_text", pa.bool_()), ("blank", pa.bool_()), ("n_children", pa.int32()), ("bindings", pa.map_(pa.string(), pa.string())),
        ("path", pa.list_(pa.string())), ("line", pa.int32()), ("column", pa.int32()), ("children", pa.list_(pa.string())), ("ups", pa.list_(pa.int64())),
    ]
)
#: Columns that are made only where they are asked for: the numbers and places of
#: an element's children, and their names and texts.
MORE = pa.schema([("kids", pa.list_(pa.struct([("node_id", pa.int64()), ("line", pa.int32()), ("column", pa.int32())]))), ("fields", pa.list_(pa.struct([("name", pa.string()), ("text", pa.string())])))])
#: Every column, and its place in a row.
_ALL = pa.schema([*SCHEMA, *MORE])
_AT = {n: i for i, n in enumerate(_ALL.names)}


def qname(ns: str, local: str) -> str:
    """Names in tables: ``{ns}local``, or ``local`` alone without a namespace."""
    return f"{{{ns}}}{local}" if ns else local


#: Characters of a document whose rows are held until it ends, bytes of a part
#: of a longer one, and rows of a batch.
WHOLE, PART, BATCH = 1 << 20, 1 << 16, 5000
_TOP = {"xml": XML_NS}
_BLANK = " \t\r\n"


class _Shredder:
    """Parses one document; ``out`` collects the rows of elements that ended."""

    def __init__(self, doc_id: str | None, out: list[tuple] | None, more: bool = False):
        self.doc_id, self.out, self.more, self.n = doc_id, out, more, 0
        self.open: list[list] = []
        p = self.p = expat.ParserCreate("utf-8")
        p.ordered_attributes = p.buffer_text = True
        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler, p.EntityDeclHandler = self.start, self.end, self.text, self.entity

    def fail(self, message: str):
        raise XmlError(message, self.p.CurrentLineNumber, self.p.CurrentColumnNumber + 1)

    def entity(self, *_) -> None:
        self.fail("an entity declaration")

    def expand(self, q: str, bindings: dict[str, str], attribute: bool) -> str:
        prefix, colon, local = q.partition(":")
        if not colon:
            return q if attribute else qname(bindings.get("", ""), q)
        if ":" in local or not prefix or not local:
            self.fail(f"{q} is no qualified name")
        if prefix not in bindings:
            self.fail(f"prefix {prefix} is not bound")
        return f"{{{bindings[prefix]}}}{local}"

    def start(self, name: str, raw: list[str]) -> None:
        p = self.p
        if self.open:
            up = self.open[-1]
            bindings, depth, sib, parent = up[9], up[2] + 1, len(up[13]), up[0]
        else:
            up, bindings, depth, sib, parent = None, _TOP, 0, 0, None
        attrs: list[dict[str, str]] = []
        kind = None
        if raw:
            pairs = list(zip(raw[::2], raw[1::2]))
            if any(k.startswith("xmlns") for k in raw[::2]):
                bindings, pairs = self.bound(pairs, bindings)
            seen = set()
            for k, v in pairs:
                n = self.expand(k, bindings, True) if ":" in k else k
                if n in seen:
                    self.fail(f"attribute {k} twice")
                seen.add(n)
                attrs.append({"name": n, "value": v})
                if n == _XSI_TYPE:
                    kind = v
        full = self.expand(name, bindings, False) if ":" in name or "" in bindings else name
        step = full
        if kind is not None:
            prefix, colon, local = kind.strip().rpartition(":")
            ns = bindings.get(prefix, "" if not colon else None)
            if ns is not None and local:
                step = f"{full}#{qname(ns, local)}"
        me = self.n
        self.n += 1
        if up is not None:
            up[13].append(full)
            path, ups = [*up[10], step], [*up[14], parent]
        else:
            path, ups = [step], []
        self.open.append([me, parent, depth, sib, full, attrs, [], [], [], bindings, path, p.CurrentLineNumber, p.CurrentColumnNumber + 1, [], ups])

    def bound(self, pairs: list[tuple[str, str]], bindings: dict[str, str]) -> tuple[dict[str, str], list[tuple[str, str]]]:
        """The bindings in scope, and the attributes that declare none."""
        own, rest = {}, []
        for k, v in pairs:
            if k == "xmlns":
                own[""] = v
            elif k.startswith("xmlns:"):
                prefix = k[6:]
                if not v:
                    self.fail(f"prefix {prefix} is bound to nothing")
                if prefix == "xmlns" or (prefix == "xml") != (v == XML_NS):
                    self.fail(f"prefix {prefix} cannot be bound so")
                own[prefix] = v
            else:
                rest.append((k, v))
        return ({k: v for k, v in (bindings | own).items() if v} if own else bindings), rest

    def text(self, s: str) -> None:
        if self.open:
            self.open[-1][6].append(s)

    def end(self, _: str) -> None:
        me, parent, depth, sib, name, attrs, texts, kids, fields, bindings, path, line, column, children, ups = self.open.pop()
        if self.out is not None:
            text = "".join(texts)
            row = (self.doc_id, None, None, me, parent, self.n - 1, depth, sib, name, attrs, text, bool(texts), not text.strip(_BLANK), len(children), list(bindings.items()), path, line, column, children, ups)
            self.out.append((*row, kids, fields) if self.more else row)
            if self.more and self.open:
                self.open[-1][7].append({"node_id": me, "line": line, "column": column})
                self.open[-1][8].append({"name": name, "text": text})


def _parts(doc_id: str | None, xml: bytes | str, out: list[tuple] | None, more: bool) -> Iterator[None]:
    """Parses a document part by part, with its rows in ``out``."""
    raw = source(xml).encode("utf-8")
    s = _Shredder(doc_id, out, more)
    try:
        for i in range(0, max(1, len(raw)), PART):
            s.p.Parse(raw[i : i + PART], i + PART >= len(raw))
            yield
    except expat.ExpatError as e:
        raise XmlError(expat.ErrorString(e.code), e.lineno, e.offset + 1) from None


def rows(doc_id: str | None, xml: bytes | str | None, more: bool = False) -> Iterator[list[tuple]]:
    """Lists of node rows of one document; none of a null.  With ``more`` they have
    the columns of ``MORE`` too."""
    if xml is None:
        return
    held: list[tuple] = []
    try:
        if len(xml) > WHOLE:
            for _ in _parts(doc_id, xml, None, False):
                pass
            for _ in _parts(doc_id, xml, held, more):
                if len(held) >= BATCH:
                    yield held.copy()
                    held.clear()
        else:
            for _ in _parts(doc_id, xml, held, more):
                pass
    except XmlError as e:
        held = [(doc_id, "xml-wf", e.message, *[None] * 13, e.line, e.column, *[None] * 4)]
    except UnicodeEncodeError as e:
        held = [(doc_id, "xml-wf", f"not a character: {e.reason}", *[None] * 13, 0, 0, *[None] * 4)]
    yield held if more else [r[: len(SCHEMA)] for r in held]


def only(columns: Sequence[str] | None) -> pa.Schema:
    return SCHEMA if columns is None else pa.schema([_ALL.field(c) for c in columns])


def batch(held: list[tuple], schema: pa.Schema = SCHEMA) -> pa.RecordBatch:
    columns = list(zip(*held))
    return pa.RecordBatch.from_arrays([pa.array(columns[_AT[f.name]], f.type) for f in schema], schema=schema)


def _shred(schema: pa.Schema, names: frozenset[str] | None):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            # as many documents at a time as are about as long as the longest
            ends = np.cumsum(np.diff(text_bytes(part.column(1))[1]))
            i = 0
            while i < len(ends):
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + WHOLE, "right")))
                yield from _some(part.column(0).slice(i, j - i), part.column(1).slice(i, j - i), schema, names)
                i = j

    return run


def _some(ids: pa.Array, texts: pa.Array, schema: pa.Schema, names: frozenset[str] | None = None) -> Iterator[pa.RecordBatch]:
    plain, made = shred_plain(ids, texts, WHOLE, schema, names)
    for i in range(0, made.num_rows if made else 0, 4 * BATCH):
        yield made.slice(i, 4 * BATCH)
    held: list[tuple] = []
    for i in np.flatnonzero(~plain).tolist():
        for some in rows(ids[i].as_py(), texts[i].as_py(), bool({"kids", "fields"} & set(schema.names))):
            held += some if names is None else [r for r in some if r[1] is not None or r[8] in names]
            if len(held) >= BATCH:
                yield batch(held, schema)
                held = []
    if held:
        yield batch(held, schema)


def shred(df: DataFrame, doc_id: str, xml: str, columns: Sequence[str] | None = None, names: Sequence[str] | None = None) -> DataFrame:
    """The nodes of a text or binary column; documents never meet, so no shuffle
    is needed.  ``columns`` are those that are read; no others are made.
    With ``names`` only elements of these get a row, and what is not well-formed."""
    schema = only(columns)
    return df.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(xml).alias("xml")).mapInArrow(_shred(schema, None if names is None else frozenset(names)), from_arrow_schema(schema))


def shred_files(spark, path: str) -> DataFrame:
    """The nodes of all files that match; the document id is the path."""
    return shred(spark.read.format("binaryFile").load(path), "path", "content")
