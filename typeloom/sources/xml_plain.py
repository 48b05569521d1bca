"""Plain XML documents, many at a time: the same nodes as by the parser.

Plain is a document of ASCII without references, comments, instructions, CDATA,
prefixes and namespaces, whose tags are written in the usual way.  Its tags are
found, matched and numbered as arrays over a batch of documents.  Whether a
document is plain and well-formed is decided here; every other one is left to the
parser, which has the last word on it.
"""

from __future__ import annotations

import re
from collections.abc import Collection

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .xml_reader import XML_NS

#: Deeper documents are the parser's.
DEEPEST = 64
_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*"
_TAG_NAME = re.compile(_NAME)
_ATTRIBUTES = rf'^( {_NAME}="[^"<]*")* ?$'
_FORBIDDEN = np.ones(256, bool)
_FORBIDDEN[0x20:0x7F] = False
_FORBIDDEN[[9, 10]] = False
_FORBIDDEN[[ord("&"), ord("]")]] = True  # references; the end of a CDATA section is no text
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 13, 32]] = False


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)


def _strings(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.StringArray:
    data = np.ascontiguousarray(buf[_spans(starts, lengths)])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(_offsets(lengths)), pa.py_buffer(data))


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(_offsets(lengths)), values)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, and where each value begins and the
    last ends."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or o[-1] == o[0]:
        return np.zeros(0, np.uint8), o - o[0]
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def shred_plain(ids: pa.Array, texts: pa.Array, longest: int, schema: pa.Schema, only: Collection[str] | None = None) -> tuple[np.ndarray, pa.RecordBatch | None]:
    """Which documents are plain and well-formed, and the nodes of those, each
    document's in the order in which they end; of ``only`` these names, if given."""
    buf, at = text_bytes(texts)
    size = np.diff(at)
    out = (size == 0) | (size > longest)
    full = ~out
    out[full] |= (buf[at[:-1][full]] != 60) | (buf[at[1:][full] - 1] != 62)
    out[_owner(at, np.flatnonzero(_FORBIDDEN[buf]))] = True
    while not out.all():
        found = _nodes(buf, at, out, ids, schema, only)
        if isinstance(found, pa.RecordBatch):
            return ~out, found
        out[found] = True  # these aren't, so once more without them
    return ~out, None


def _owner(at: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(at, places, "right") - 1


def _nodes(buf: np.ndarray, at: np.ndarray, out: np.ndarray, ids: pa.Array, schema: pa.Schema, only: Collection[str] | None) -> pa.RecordBatch | np.ndarray:
    """The nodes of all documents but those that are out; or numbers of documents
    that are not plain."""
    lt, close = np.flatnonzero(buf == 60), np.flatnonzero(buf == 62)
    doc = _owner(at, lt)
    keep = ~out[doc]
    lt, doc = lt[keep], doc[keep]
    # each document ends with a >, so there is one after each <
    gt = close[np.searchsorted(close, lt)]
    last = np.append(doc[1:] != doc[:-1], True)
    limit = np.where(last, at[doc + 1], np.append(lt[1:], 0))
    odd = (gt >= limit) | (last & (gt != at[doc + 1] - 1))
    if odd.any():
        return doc[odd]
    end = buf[lt + 1] == 47
    empty = ~end & (buf[gt - 1] == 47)
    begin, stop = lt + 1 + end, gt - empty
    spaces = np.append(np.flatnonzero(buf == 32), len(buf))
    name_end = np.minimum(spaces[np.searchsorted(spaces, begin)], stop)
    odd = (name_end <= begin) | (end & (name_end != gt))
    white = np.flatnonzero((buf == 9) | (buf == 10))
    i = np.searchsorted(lt, white, "right") - 1
    inside = (i >= 0) & (white < gt[i])
    odd[i[inside]] = True
    if odd.any():
        return doc[odd]
    names = _strings(buf, begin, name_end - begin).dictionary_encode()
    name = names.indices.to_numpy()
    words = names.dictionary
    odd = ~np.array([_TAG_NAME.fullmatch(w) is not None for w in words.to_pylist()], bool)[name]
    has = np.flatnonzero(stop > name_end)
    fine = pc.match_substring_regex(_strings(buf, name_end[has], (stop - name_end)[has]), _ATTRIBUTES)
    odd[has[~fine.to_numpy(zero_copy_only=False)]] = True
    if odd.any():
        return doc[odd]

    # elements, their ends and parents
    step = np.where(end, -1, np.where(empty, 0, 1))
    after = np.cumsum(step)
    first = np.flatnonzero(np.append(True, last[:-1]))
    uneven = np.add.reduceat(step, first) != 0
    if uneven.any():
        return doc[first[uneven]]
    odd = np.where(last, after != 0, after < 1) | (after > DEEPEST)
    if odd.any():
        return doc[odd]
    level = np.where(end | empty, after, after - 1)
    paired = np.flatnonzero(~empty)
    paired = paired[np.argsort(level[paired], kind="stable")]
    opened, closed = paired[0::2], paired[1::2]
    odd = name[opened] != name[closed]
    if odd.any():
        return doc[opened[odd]]
    ends_at = np.arange(len(lt))
    ends_at[opened] = closed
    began = np.arange(len(lt))
    began[closed] = opened
    tag = np.flatnonzero(~end)  # of each element
    number = np.cumsum(~end) - 1  # elements so far, less one
    n = len(tag)
    depth, owner, kind, till = level[tag], doc[tag], name[tag], ends_at[tag]
    base = number[first][np.searchsorted(doc[first], owner)]
    me = np.arange(n) - base
    parent = np.full(n, -1)
    above = np.flatnonzero(depth == 0)
    for d in range(1, int(depth.max()) + 1):
        here = np.flatnonzero(depth == d)
        parent[here] = above[np.searchsorted(above, here) - 1]
        above = here
    inner = np.flatnonzero(parent >= 0)
    kids = inner[np.argsort(parent[inner], kind="stable")]  # children by parent, in order
    n_children = np.bincount(parent[inner], minlength=n)
    kids_at = np.cumsum(n_children) - n_children
    sib = np.zeros(n, np.int64)
    sib[kids] = np.arange(len(kids)) - kids_at[parent[kids]]

    # attributes
    quote = np.flatnonzero(buf == 34)
    i = np.searchsorted(lt, quote, "right") - 1
    inside = (i >= 0) & (quote < gt[i])
    quote, i = quote[inside], i[inside]
    left, right, of = quote[0::2], quote[1::2], i[0::2]
    again = np.append(False, of[1:] == of[:-1])
    from_ = np.where(again, np.append(0, right[:-1]) + 2, name_end[of] + 1)
    attribute = _strings(buf, from_, left - 1 - from_).dictionary_encode()
    label = attribute.indices.to_numpy().astype(np.int64)
    spaced = np.array([w.startswith("xmlns") for w in attribute.dictionary.to_pylist()], bool)
    odd = spaced[label] if len(label) else np.zeros(0, bool)
    if again.any():
        both = of * max(1, len(spaced)) + label
        order = np.argsort(both, kind="stable")
        odd[order[1:][both[order[1:]] == both[order[:-1]]]] = True
    if odd.any():
        return doc[of[odd]]

    order = np.argsort(till, kind="stable")
    if only is not None:
        order = order[np.array([w in only for w in words.to_pylist()], bool)[kind[order]]]
    m = len(order)
    wanted = set(schema.names)
    made: dict[str, pa.Array] = {}
    line = column = None
    if wanted & {"line", "column", "kids"}:
        newline = np.flatnonzero(buf == 10)
        p, start = lt[tag], at[owner]
        before = np.searchsorted(newline, p)
        line = before - np.searchsorted(newline, start) + 1
        near = np.concatenate(([-1], newline))[before] + 1
        column = p - np.maximum(near, start) + 1
    if wanted & {"text", "has_text", "blank", "fields"}:
        t = np.flatnonzero(~last)
        t = t[lt[t + 1] > gt[t] + 1]  # tags with text after them
        e = number[began[t]]
        whose = np.where(end[t] | empty[t], parent[e], e)
        by = np.argsort(whose, kind="stable")
        t, whose = t[by], whose[by]
        start, length = gt[t] + 1, lt[t + 1] - gt[t] - 1
        total = np.bincount(whose, length, n).astype(np.int64)
        made["has_text"] = pa.array((total > 0)[order])
        if "blank" in wanted:
            solid = np.concatenate(([0], np.cumsum(_SOLID[buf])))
            some = np.bincount(whose, solid[start + length] - solid[start], n)
            made["blank"] = pa.array((some == 0)[order])
        joined, from_text = buf[_spans(start, length)], np.cumsum(total) - total
        if "text" in wanted:
            made["text"] = _strings(joined, from_text[order], total[order])
    put = lambda c, values, kind: made.__setitem__(c, pa.array(values[order], kind)) if c in wanted else None
    put("node_id", me, pa.int64())
    put("last_id", number[till] - base, pa.int64())
    put("depth", depth, pa.int32())
    put("sib", sib, pa.int32())
    put("n_children", n_children, pa.int32())
    if line is not None:
        put("line", line, pa.int32())
        put("column", column, pa.int32())
    if "parent_id" in wanted:
        made["parent_id"] = pa.array(np.where(parent < 0, 0, me[parent])[order], pa.int64(), mask=(parent < 0)[order])
    if "doc_id" in wanted:
        made["doc_id"] = ids.take(pa.array(owner[order]))
    if "name" in wanted:
        made["name"] = words.take(pa.array(kind[order]))
    if wanted & {"path", "ups"}:
        length = depth[order] + 1
        place = np.cumsum(length) - length
        chain = np.empty(int(length.sum()), np.int64)
        up, left_ = order.copy(), np.arange(m)
        while len(left_):
            chain[place[left_] + depth[up]] = up
            up = parent[up]
            left_, up = left_[up >= 0], up[up >= 0]
        if "path" in wanted:
            made["path"] = _lists(length, words.take(pa.array(kind[chain])))
        if "ups" in wanted:
            proper = np.ones(len(chain), bool)
            proper[place + length - 1] = False
            made["ups"] = _lists(length - 1, pa.array(me[chain[proper]], pa.int64()))
    if wanted & {"children", "kids", "fields"}:
        each = kids[_spans(kids_at[order], n_children[order])]
        if "children" in wanted:
            made["children"] = _lists(n_children[order], words.take(pa.array(kind[each])))
        if "kids" in wanted:
            made["kids"] = _lists(n_children[order], pa.StructArray.from_arrays([pa.array(me[each], pa.int64()), pa.array(line[each], pa.int32()), pa.array(column[each], pa.int32())], ["node_id", "line", "column"]))
        if "fields" in wanted:
            made["fields"] = _lists(n_children[order], pa.StructArray.from_arrays([words.take(pa.array(kind[each])), _strings(joined, from_text[each], total[each])], ["name", "text"]))
    if "attrs" in wanted:
        count = np.bincount(number[of], minlength=n)
        each = _spans((np.cumsum(count) - count)[order], count[order])
        value = _strings(buf, left[each] + 1, (right - left - 1)[each])
        made["attrs"] = _lists(count[order], pa.StructArray.from_arrays([attribute.dictionary.take(pa.array(label[each])), value], ["name", "value"]))
    if "bindings" in wanted:
        made["bindings"] = pa.MapArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32)), pa.repeat("xml", m), pa.repeat(XML_NS, m))
    return pa.RecordBatch.from_arrays([made[f.name] if f.name in made else pa.nulls(m, f.type) for f in schema], schema=schema)
