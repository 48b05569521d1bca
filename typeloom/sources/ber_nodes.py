"""BER documents as a table of nodes, by a map of tags.

A value is an identifier, a length and contents; contents of a constructed value
are values again.  The caller's map says, below which element, which element a
tag is and how its contents read: ``integer``, ``boolean``, ``text``, ``hex``, or
``none`` for one that holds others.  A tag that the map does not have becomes an
element ``tag-<class>-<number>``, which a content model then rejects.  Definite
and indefinite lengths and long tags are read; what is no BER, or goes on after
its one value, is one row with rule ``ber-wf``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .xml_nodes import BATCH, NODES, SCHEMA

#: Parent's name, empty at the top, to (class, number) to (name, reading).
TagMap = dict[str, dict[tuple[int, int], tuple[str, str]]]
UNIVERSAL, APPLICATION, CONTEXT, PRIVATE = range(4)


class BerError(ValueError):
    pass


def header(data: bytes, at: int) -> tuple[int, int, bool, int, int]:
    """(class, number, constructed, place of the contents, their length or -1)."""
    try:
        first = data[at]
        at += 1
        number = first & 31
        if number == 31:
            number = 0
            while True:
                b = data[at]
                at += 1
                number = number << 7 | b & 127
                if not b & 128:
                    break
        size = data[at]
        at += 1
        if size == 128:
            if not first & 32:
                raise BerError("a primitive value without a length")
            size = -1
        elif size > 128:
            n = size & 127
            if at + n > len(data):
                raise IndexError
            size = int.from_bytes(data[at : at + n], "big")
            at += n
    except IndexError:
        raise BerError("it ends inside a header") from None
    if size >= 0 and at + size > len(data):
        raise BerError("contents are longer than the data")
    return first >> 6, number, bool(first & 32), at, size


def reading(kind: str, raw: bytes) -> str:
    if kind == "integer":
        return str(int.from_bytes(raw, "big", signed=True))
    if kind == "boolean":
        return "true" if any(raw) else "false"
    if kind == "text":
        try:
            return raw.decode()
        except UnicodeDecodeError:
            raise BerError("text that is not UTF-8") from None
    return raw.hex().upper()


def rows(tags: TagMap, doc_id: str | None, data: bytes | None) -> list[tuple]:
    """Node rows of one document; none of a null."""
    if data is None:
        return []
    out: list[list] = []
    # open elements: (number of the node, end of its contents or -1, its name, its path, its ancestors)
    open_: list[tuple[int | None, int, str, list[str], list[int]]] = [(None, len(data), "", [], [])]
    at = 0
    try:
        while True:
            me, end, name, path, ups = open_[-1]
            done = at >= len(data) if me is None else at == end
            if end >= 0 and at > end:
                raise BerError("a value goes beyond the one around it")
            if end < 0 and data[at : at + 2] == b"\0\0":
                at, done = at + 2, True
            if done:
                if me is None:
                    break
                out[me][5] = len(out) - 1
                open_.pop()
                continue
            if me is None and out:
                raise BerError("data after the value")
            kind, number, constructed, start, size = header(data, at)
            child, reads = tags.get(name, {}).get((kind, number), (f"tag-{kind}-{number}", "none" if constructed else "hex"))
            n, parent = len(out), me
            if parent is not None:
                out[parent][18].append(child)
                out[parent][13] += 1
            here = [*path, child]
            below = ups if parent is None else [*ups, parent]
            text = "" if constructed else reading(reads, data[start : start + size])
            out.append([doc_id, None, None, n, parent, n, len(here) - 1, 0 if parent is None else len(out[parent][18]) - 1, child, [], text, text != "", not text.strip(" \t\r\n"), 0, [], here, None, None, [], below])
            at = start
            if constructed:
                open_.append((n, -1 if size < 0 else start + size, child, here, below))
            else:
                at += size
        if not out:
            raise BerError("no value")
    except BerError as e:
        return [(doc_id, "ber-wf", str(e), *[None] * 17)]
    return [tuple(r) for r in out]


def _shred(tags: TagMap):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for part in parts:
            for doc_id, data in zip(part.column(0).to_pylist(), part.column(1)):
                held += rows(tags, doc_id, data.as_py())
                if len(held) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), SCHEMA)], schema=SCHEMA)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), SCHEMA)], schema=SCHEMA)

    return run


def shred_ber(df: DataFrame, doc_id: str, data: str, tags: TagMap) -> DataFrame:
    """The nodes of a binary column."""
    return df.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(data).cast("binary").alias("data")).mapInArrow(_shred(tags), NODES)
