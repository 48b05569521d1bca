"""Best-fit packing of tokenised documents by minimum bin slack.

Pieces have lengths of 1 to ``size`` tokens, so the whole problem is a histogram
of at most ``size`` counts, however many pieces there are.  The driver packs the
histogram: each bin takes the longest length left, then the fullest feasible
combination of the others, found by subset-sum dynamic programming over bitsets;
the combination is removed as many times as the counts allow before the next is
searched, which is what repeating the search would do.  Pieces take their places
by their rank among pieces of equal length.  Ranks come from salted groups, dealt
out row by row, so neither a length nor a row that a third of all pieces have is
a hot group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stages, batches, read

SIZE, END = 1024, 2
#: Groups that the pieces of one length are ranked in.
SALTS = 1024
_ENCODINGS: dict[str, object] = {}


def encoder(ranks_path: str | None = None):
    """The byte-level BPE of a rank file, with <|endoftext|> as its special
    token; one per process."""
    import base64

    import public_tokenizers
    import tiktoken

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _ENCODINGS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
    return _ENCODINGS[path]


def tokenizer(path: str | None = None):
    """The tokenizers library's form of the same vocabulary; one per process."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("byte_bpe_50k.json")
    if path not in _ENCODINGS:
        _ENCODINGS[path] = Tokenizer.from_file(path)
        _ENCODINGS[path].no_padding()
        _ENCODINGS[path].no_truncation()
    return _ENCODINGS[path]


def encode(text: str | None, ranks_path: str | None = None, library_path: str | None = None) -> np.ndarray:
    """Token ids as unsigned 32-bit numbers; none of a null or empty text.
    ``library_path`` is the same vocabulary in the tokenizers library's form."""
    if not text:
        return np.empty(0, np.uint32)
    try:
        return encoder(ranks_path).encode_to_numpy(text, allowed_special="all")
    except ValueError:  # the pattern's backtracking stack is too small for a huge run of white space
        if ranks_path is not None and library_path is None:
            raise
        return np.array(tokenizer(library_path).encode(text, add_special_tokens=False).ids, np.uint32)


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first is shorter."""
    first = n % size or min(n, size)
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def _pieces(ranks_path: str | None, library_path: str | None, size: int, schema: pa.Schema):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one():
            salt = TaskContext.get().partitionId()
            for part in parts:
                for key, text in zip(part.column(0).to_pylist(), part.column(1)):
                    ids = np.append(encode(text.as_py(), ranks_path, library_path), np.uint32(END)).astype("<u4")
                    for k, (s, n) in enumerate(cut(len(ids), size)):
                        salt = (salt + 1) % SALTS
                        yield key, k, s, n, zlib.crc32(ids[s : s + n]), salt

        yield from batches(one(), schema)

    return run


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the greatest sum up to room;
    of equal sums, one that leaves short lengths unused."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(available, reverse=True):
        if length > room:
            continue
        left, part = min(available[length], room // length), 1
        while left:
            k = min(part, left)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            left -= k
            part *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + k
            at -= length * k
    return used


def pack(counts: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """(combination, times) that use up all counts."""
    left = {k: n for k, n in counts.items() if n}
    out = []
    while left:
        top = max(left)
        left[top] -= 1
        used = fullest({k: n for k, n in left.items() if n}, size - top)
        left[top] += 1
        used[top] = used.get(top, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((used, times))
    return out


class Slots:
    """Where the r-th piece of a length goes."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        bins = 0
        for combination, times in plan:
            offset = 0
            for length, k in sorted(combination.items(), reverse=True):
                rows.setdefault(length, []).append((used.get(length, 0), bins, k, offset))
                used[length] = used.get(length, 0) + k * times
                offset += length * k
            bins += times
        self.bins = bins
        self.by_length = {k: np.array(v, np.int64).T for k, v in rows.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            first, bins, k, offset = self.by_length[n]
            j = np.searchsorted(first, rank[at], side="right") - 1
            i = rank[at] - first[j]
            seq[at], off[at] = bins[j] + i // k[j], offset[j] + i % k[j] * n
        return seq, off


def _place(slots: Slots):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            seq, off = slots.place(part.column("length").to_numpy(), part.column("rank").to_numpy())
            cols = part.drop_columns(["rank"])
            yield cols.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    return run


class Packing:
    """Packs a table's texts into sequences of at most ``size`` tokens.

    Defined results: a null or empty text is the end token alone; repeated rows
    are packed each; a very long text is cut into as many pieces as it needs; of
    equally full combinations one that leaves short lengths is taken, and pieces
    of one length may take each other's place; an empty table gives no pieces.
    Only key and text are read.
    """

    def __init__(self, key: str = "doc_id", text: str = "text", *, size: int = SIZE, ranks_path: str | None = None, library_path: str | None = None):
        self.key, self.text, self.size, self.ranks_path, self.library_path = key, text, size, ranks_path, library_path

    def __call__(self, df: DataFrame) -> DataFrame:
        from pyspark.sql.pandas.types import to_arrow_type

        stages = Stages(df.sparkSession, "packing")
        kind = df.schema[self.key].dataType
        schema = pa.schema([("k", to_arrow_type(kind)), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("salt", pa.int32())])
        ddl = f"k {kind.simpleString()}, piece int, start long, length long, ids_crc32 long"
        cut_ = stages.put(df.select(F.col(self.key).alias("k"), F.col(self.text).alias("t")).mapInArrow(_pieces(self.ranks_path, self.library_path, self.size, schema), ddl + ", salt int"), "pieces")
        # a full piece fills a sequence: it needs a number of its own and no rank
        full, part = cut_.where(F.col("length") == self.size), cut_.where(F.col("length") < self.size)
        counts = stages.put(part.groupBy("length", "salt").agg(F.count("*").alias("c")), "counts")
        # at most size * SALTS rows, whatever the table
        before = counts.select("length", "salt", (F.sum("c").over(Window.partitionBy("length").orderBy("salt")) - F.col("c")).alias("before"))
        histogram = {r.length: r.c for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # below ``size`` rows
        slots = Slots(pack(histogram, self.size))
        order = Window.partitionBy("length", "salt").orderBy("k", "piece", "start", "ids_crc32")
        ranked = part.withColumn("r", F.row_number().over(order)).join(before, ["length", "salt"])
        placed = ranked.select("k", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("r") - 1).alias("rank")).mapInArrow(_place(slots), f"{ddl}, sequence_id long, offset long")
        alone = full.select("k", "piece", "start", "length", "ids_crc32", (F.monotonically_increasing_id() + slots.bins).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
        out = stages.put(placed.unionByName(alone), "placed")
        stages.drop(cut_, counts)
        return out.withColumnRenamed("k", self.key)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Packing()(read(spark, sf_dir, "documents"))
