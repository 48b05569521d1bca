"""Exact removal of repeated word windows by relative Lempel-Ziv parsing.

A window is ``window`` consecutive words of one document; each word covered by
a window whose words also start anywhere else in the corpus is removed.

The reference is the corpus itself, indexed in *blocks* at content-defined
anchors: each window takes the leftmost least q-gram hash inside it as its
anchor, and a block is the words of all consecutive windows with one anchor.
Equal windows have equal anchors at equal places, so whatever a document shares
with a reference block, it shares around an anchor that both have: the anchor is
the index's key, and no other block can hold a long enough match.

1. Anchors are counted.  One that occurs once has nothing to match.
2. Blocks with equal words match as a whole: their content hash says so.
3. Of an anchor with several contents, the widest is its reference block.  Every
   other one is parsed relative to it: the match grows from the anchor to both
   sides, word by word, as far as it goes.  A match of a window's length or more
   is a factor, of the document and of the reference.
4. Windows at a factor's boundary, which the match does not hold, can only equal
   boundary windows of further blocks of that anchor (one that the reference has
   would lie in the match).  Their hashes are counted.
5. A document is factored from left to right: at each place the longest of its
   matches is taken, and what they cover goes.

So the result is that of comparing every window with every other one.

At scale: anchors are counted before anything is joined (8 bytes each, combined
before the shuffle) and about one word in ten has one; positions are kept only
for repeated anchors, words only for blocks that share an anchor with a
different block.  An anchor's reference is one block of fewer than twice a
window's words, so a hot anchor's blocks are split over tasks with a copy of it;
hot contents are aggregated, never grouped.  Texts are shuffled once for the
parse and once for the result, by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, Stages, batches, mix, ngrams, read, word_hashes, words

_ODD = np.uint64(0xD6E8FEB86659FD93)
_INV = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_SLICE = 1 << 16


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64))))


class Blocks:
    """Blocks of one word sequence: ``lo`` and ``hi`` are their first and last
    window, ``place`` is the anchor's distance from the first word, ``anchor`` and
    ``content`` are hashes of the anchor and of all words."""

    def __init__(self, h: np.ndarray, window: int, gram: int):
        n = len(h) - window + 1
        if n <= 0:
            self.lo = self.hi = self.place = np.empty(0, np.int64)
            self.anchor = self.content = h[:0]
            return
        g, span = ngrams(h, gram), window - gram + 1
        at = np.empty(n, np.int64)
        for i in range(0, n, _SLICE):  # bounded memory for very long texts
            part = sliding_window_view(g[i : i + _SLICE + span - 1], span)[: n - i]
            at[i : i + len(part)] = part.argmin(axis=1) + np.arange(i, i + len(part))
        new = np.flatnonzero(np.diff(at, prepend=-1))
        self.lo, self.hi = new, np.append(new[1:], n) - 1
        anchors = at[new]
        self.anchor = g[anchors]
        # hash of a range of words from prefix sums, made independent of its place
        p = _powers(_ODD, len(h))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * p[:-1], dtype=np.uint64)))
        q = _powers(_INV, len(h))
        body = (total[self.hi + window] - total[self.lo]) * q[self.lo]
        self.place = anchors - self.lo
        shape = self.place.astype(np.uint64) * np.uint64(1 << 20) + (self.hi - self.lo).astype(np.uint64)
        self.content = mix(mix(body, shape), self.anchor)


def packed(lo: np.ndarray, hi: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A block's place in one number: windows have fewer than 4096 words."""
    return (lo << 24) | ((hi - lo) << 12) | place


def unpacked(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pos >> 24, (pos >> 24) + ((pos >> 12) & 4095), pos & 4095


_BLOCK = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("rid", pa.int64()), ("nb", pa.int32()), ("pos", pa.int64())])
_PIECE = pa.schema([("a", pa.int64()), ("k", pa.int64()), ("rid", pa.int64()), ("nb", pa.int32()), ("pos", pa.int64()), ("ref", pa.bool_()), ("w", pa.list_(pa.int64()))])
_FOUND = pa.schema([("w", pa.int64()), ("k", pa.int64()), ("rid", pa.int64()), ("nb", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _rows(columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _block_rows(window: int, gram: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts:
            for rid, nb, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                b = Blocks(word_hashes(words(text.as_py())), window, gram)
                if len(b.lo):
                    k = len(b.lo)
                    held.append((b.anchor.view(np.int64), b.content.view(np.int64), np.full(k, rid), np.full(k, nb, np.int32), packed(b.lo, b.hi, b.place)))
                    size += k
                    if size * 36 > BATCH_BYTES:
                        yield _rows(map(np.concatenate, zip(*held)), _BLOCK)
                        held, size = [], 0
        if held:
            yield _rows(map(np.concatenate, zip(*held)), _BLOCK)

    return run


def _anchors(window: int, gram: int, schema: pa.Schema):
    blocks = _block_rows(window, gram)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(parts):
            yield pa.RecordBatch.from_arrays([b.column(0)], schema=schema)

    return run


def _pieces(window: int, gram: int):
    """The listed blocks with their words, as hashes: the anchor's first word is
    number ``window - gram`` of a row, and words beyond the block are 0."""
    side = window - gram
    width = side + window

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rid, nb, text, at in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3)):
                h = np.concatenate((word_hashes(words(text.as_py())), np.zeros(1, np.uint64)))
                a, k, ref, pos = (at.values.field(c).to_numpy(zero_copy_only=False) for c in ("a", "k", "ref", "pos"))
                for i in range(0, len(pos), _SLICE >> 4):  # bounded memory for very long texts
                    part_ = slice(i, i + (_SLICE >> 4))
                    lo, hi, place = unpacked(pos[part_])
                    j = (lo + place - side)[:, None] + np.arange(width)
                    inside = (j >= lo[:, None]) & (j < (hi + window)[:, None])
                    w = np.where(inside, h[np.where(inside, j, -1)], 0).view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(lo) + 1) * width, pa.int32()), pa.array(w.ravel()))
                    yield _rows((a[part_], k[part_], np.full(len(lo), rid), np.full(len(lo), nb, np.int32), pos[part_], ref[part_], lists), _PIECE)

    return run


def matches(x: np.ndarray, y: np.ndarray, side: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest common ranges ``[first, last)`` around the anchors of aligned
    rows of words (a word of neither block is no match: see ``_relative``)."""
    same = x == y
    left = np.logical_and.accumulate(same[:, :side][:, ::-1], axis=1).sum(axis=1)
    right = np.logical_and.accumulate(same[:, side + gram :], axis=1).sum(axis=1)
    return side - left, side + gram + right


def _relative(window: int, gram: int):
    """Parses blocks relative to their reference: rows with k = 0 are factors,
    ranges of windows; the others are single windows at a factor's boundary."""
    side = window - gram
    width = side + window

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            k, rid, nb, pos, rk, rrid, rnb, rpos = (part.column(i).to_numpy() for i in range(8))
            x, y = (part.column(i).flatten().to_numpy().view(np.uint64).reshape(-1, width) for i in (8, 9))
            first, last = matches(x, y, side, gram)
            lo, hi, place = unpacked(pos)
            rlo, rhi, rplace = unpacked(rpos)
            # the match ends with the shorter block: there a row is only filled up
            first = np.maximum(first, side - np.minimum(place, rplace))
            last = np.minimum(last, np.minimum(side - place + hi - lo, side - rplace + rhi - rlo) + window)
            stop = last - window  # the last window that the match holds
            found = stop >= first
            shift, rshift = lo + place - side, rlo + rplace - side
            out = []
            for one, d, n, s in ((found & (k == 1), rid, nb, shift), (found & (rk == 1), rrid, rnb, rshift)):
                m = int(one.sum())
                out.append((np.zeros(m, np.int64), np.zeros(m, np.int64), d[one], n[one], (first + s)[one], (stop + s)[one]))
            start = np.arange(side + 1)
            own = (start >= (side - place)[:, None]) & (start <= (side - place + hi - lo)[:, None])
            i, j = np.nonzero(own & ~(found[:, None] & (start >= first[:, None]) & (start <= stop[:, None])))
            g = ngrams(x.ravel(), window)[i * width + j].view(np.int64)
            out.append((g, k[i], rid[i], nb[i], j + shift[i], j + shift[i]))
            yield _rows(map(np.concatenate, zip(*out)), _FOUND)

    return run


def factors(lo: np.ndarray, hi: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The factors of a document from its matches (ranges of windows): word
    ranges [start, end) from left to right, where at each place the match that
    reaches furthest is taken, and one factor ends where no match goes on."""
    order = np.argsort(lo, kind="stable")
    start, end = lo[order], np.maximum.accumulate(hi[order] + window)
    first = np.ones(len(start), bool)
    first[1:] = start[1:] > end[:-1]
    return start[first], end[np.append(np.flatnonzero(first)[1:] - 1, len(end) - 1)]


def _lo() -> Column:
    return F.shiftright("pos", 24).cast("int")


def _hi() -> Column:
    return _lo() + F.shiftright("pos", 12).bitwiseAND(4095).cast("int")


class SubstringDedup:
    """Duplicate spans of a table's texts, and the texts without them.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Defined results: null, empty
    and short texts have no window and lose nothing; every occurrence of a
    repeated window goes, the first included, also inside one document; repeated
    rows and equal texts are duplicates of each other.  An empty table gives an
    empty result.  Other columns are passed by ``remove`` and may have any names.
    """

    def __init__(self, text: str = "text", *, window: int = 35, gram: int = 16):
        if not 1 <= gram <= window < 4096:
            raise ValueError("an anchor must fit into a window, of fewer than 4096 words")
        self.text, self.window, self.gram = text, window, gram

    def spans(self, df: DataFrame, stages: Stages) -> DataFrame:
        """``(rid, nb, at array<struct<lo, hi>>)``: ranges of repeated windows of
        the texts with that hash and length."""
        t = F.col(self.text)
        docs = df.where(F.length(t) >= 2 * self.window - 1).select(F.xxhash64(t).alias("rid"), F.octet_length(t).alias("nb"), t.alias("t"))
        size = (self.window, self.gram)
        anchors = docs.mapInArrow(_anchors(*size, pa.schema([("a", pa.int64())])), "a long")
        again = stages.put(anchors.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select("a"), "anchors")
        blocks = stages.put(docs.mapInArrow(_block_rows(*size), _ddl(_BLOCK)).join(again, "a", "left_semi"), "blocks")
        # one row per content, with one of its occurrences
        index = stages.put(blocks.groupBy("c").agg(F.count("*").alias("k"), *(F.first(c).alias(c) for c in ("a", "rid", "nb", "pos"))), "index")
        whole = blocks.join(index.where("k > 1").select("c"), "c", "left_semi").select("rid", "nb", _lo().alias("lo"), _hi().alias("hi"))
        # the index: of each anchor with several contents, the widest
        mixed = index.groupBy("a").agg(F.count("*").alias("m"), F.max_by("c", _hi() - _lo()).alias("ref")).where("m > 1").select("a", "ref")
        edges = index.join(stages.put(mixed, "references"), "a").select("rid", "nb", F.struct("a", "k", (F.col("c") == F.col("ref")).alias("ref"), "pos").alias("at"))
        edges = edges.groupBy("rid", "nb").agg(F.collect_list("at").alias("at"))
        pieces = stages.put(docs.join(edges, ["rid", "nb"]).select("rid", "nb", "t", "at").mapInArrow(_pieces(*size), _ddl(_PIECE)), "pieces")
        # a text that occurs twice has its reference blocks twice
        refs = pieces.where("ref").dropDuplicates(["a"]).select("a", *(F.col(c).alias(f"r{c}") for c in ("k", "rid", "nb", "pos", "w")))
        pairs = pieces.where("not ref").join(refs, "a").select("k", "rid", "nb", "pos", "rk", "rrid", "rnb", "rpos", "w", "rw")
        found = stages.put(pairs.mapInArrow(_relative(*size), _ddl(_FOUND)), "factors")
        edge = found.where("k > 0")
        twice = edge.groupBy("w").agg(F.sum("k").alias("n")).where("n > 1").select("w")
        at_edge = edge.where("k = 1").join(twice, "w", "left_semi").select("rid", "nb", "lo", "hi")
        every = whole.union(found.where("k = 0").select("rid", "nb", "lo", "hi")).union(at_edge)
        out = stages.put(every.groupBy("rid", "nb").agg(F.collect_set(F.struct("lo", "hi")).alias("at")), "spans")
        stages.drop(blocks, index, pieces, found, again)
        return out

    def _apply(self, df: DataFrame, stages: Stages, run, out: pa.Schema, ddl: str) -> DataFrame:
        found = self.spans(df, stages)
        inner = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]
        t = F.col(self.text)
        marked = df.select(*inner, F.xxhash64(t).alias("rid"), F.octet_length(t).alias("nb"))
        return marked.join(found, ["rid", "nb"], "left").drop("rid", "nb").mapInArrow(run(df.columns.index(self.text), self.window, out), ddl)

    def remove(self, df: DataFrame) -> DataFrame:
        """The table with the kept words, joined by one space, as its text.  A
        text that loses nothing stays as it is."""
        stages = Stages(df.sparkSession, "substring")
        kinds = [f.dataType.simpleString() for f in df.schema]
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(df.schema)
        names = [f"c{i}" for i in range(len(kinds))]
        out = pa.schema([pa.field(n, f.type) for n, f in zip(names, out)])
        ddl = ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
        return self._apply(df, stages, _removed, out, ddl).toDF(*df.columns)


def _cut(ws: list[bytes], at, window: int) -> list[bytes]:
    if at is None:
        return ws
    start, end = factors(np.array(at.field("lo"), np.int64), np.array(at.field("hi"), np.int64), window)
    kept, last = [], 0
    for s, e in zip(start.tolist(), end.tolist()):
        kept += ws[last:s]
        last = e
    return kept + ws[last:]


def _removed(column: int, window: int, schema: pa.Schema):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, texts = part.column(part.num_columns - 1), part.column(column)
            new = [t.as_py() if not a.is_valid else b" ".join(_cut(words(t.as_py()), a.values, window)).decode() for t, a in zip(texts, at)]
            cols = [pa.array(new, schema.field(column).type) if i == column else part.column(i).cast(schema.field(i).type) for i in range(len(schema))]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def _digests(column: int, window: int, schema: pa.Schema):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one():
            for part in parts:
                for d, t, a in zip(part.column(0).to_pylist(), part.column(column), part.column(part.num_columns - 1)):
                    ws = words(t.as_py())
                    kept = _cut(ws, a.values if a.is_valid else None, window)
                    yield d, len(ws), len(ws) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

        yield from batches(one(), schema)

    return run


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    return SubstringDedup()._apply(docs, Stages(spark, "substring"), _digests, out, "doc_id long, n_words long, n_removed long, kept_sha256 string")
