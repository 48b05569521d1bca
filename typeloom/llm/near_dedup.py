"""Near-duplicate groups by tensored MinHash banding, verified on full sets.

Two collections of ``m`` small sketches (``rows`` MinHash values each) are
computed per document.  A table is a *pair* of sketches, one from each
collection, so ``2 * m * rows`` hash functions give ``m * m`` tables: the number
of MinHash evaluations is about the square root of what separate tables need.
``m`` follows from the threshold and from the chance ``miss`` with which a pair
exactly at the threshold may share no table.

What happens at scale:

* Documents with one and the same shingle set are one class (128-bit digest);
  everything after works on classes, so exact copies never meet in a bucket.
* A sketch that only one class has cannot be half of a shared table, and of
  sketches that the very same classes have, one says all.  So sketches are
  counted first (8 bytes each, combined before the shuffle), and only what is
  left of them is paired to keys.
* Every member of a bucket meets one pivot, the bucket's least class.  That
  joins a cluster of copies, however large, without forming its pairs.
* Buckets that then still lie in several components hold texts that are alike,
  but mostly not near: pages of one template, say.  Their members meet by
  prefixes instead.  In one order of all shingles, rare ones first, two sets at
  the threshold share a shingle among the first ``n - ceil(t * n) + 1`` of each,
  so a template's common shingles bring nobody together.  These smaller buckets
  are compared with pivots, 4, then 16, 64 ... a round and only across
  components, until each lies in one component or all its members were pivots.
* A pair is compared on full sets only where its intersection can be large
  enough by an upper bound: the sum of the smaller counts of each hash bin, with
  one to two shingles to a bin.  That takes an eighth of a set's bytes or less.
* None of this drops a pair at the threshold that shares a table.
* Components come from alternating large-star and small-star steps on tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import BATCH_BYTES, Stages, batches, mix, ngrams, read, word_hashes

_PERM_COLUMNS = 8192
#: Pivots of a prefix bucket in the first round; each round has four times as many.
FIRST_PIVOTS = 4
#: Bins in which shingles are counted to tell rare ones: a fixed 2 MB.
ORDER_BINS = 1 << 18


def sketches_per_collection(threshold: float, rows: int, miss: float) -> int:
    """The least m with which a pair at the threshold shares no table with a
    chance of at most ``miss``."""
    one = 1 - threshold**rows
    return max(1, math.ceil(math.log(miss / 2) / math.log(one)))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles.  A-Z are lower-cased;
    a text shorter than a shingle is one shingle; one without words has none."""
    if not text:
        return np.empty(0, np.uint64)
    h = word_hashes(text.encode().lower().split())
    if len(h) < size:
        # its length enters, so that short sequences cannot meet full shingles
        return mix(ngrams(h, len(h)), np.full(1, len(h), np.uint64)) if len(h) else h
    return np.unique(ngrams(h, size))


class MinHasher:
    """Two collections of m sketches of ``rows`` MinHash values each."""

    def __init__(self, m: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.m, self.rows = m, rows
        n = 2 * m * rows
        self.mul = rng.integers(1, 1 << 63, n, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, n, dtype=np.uint64)[:, None]
        self.salt = rng.integers(0, 1 << 63, 2 * m, dtype=np.uint64)

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        """2m hashes: the first m of one collection, the rest of the other.
        Each includes its place, so different places never compare equal."""
        low = np.full(len(self.mul), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), _PERM_COLUMNS):
            np.minimum(low, (shingles[None, i : i + _PERM_COLUMNS] * self.mul + self.add).min(axis=1), out=low)
        out = self.salt
        for column in low.reshape(2 * self.m, self.rows).T:
            out = mix(out, column)
        return out


def _signatures(size: int, m: int, rows: int, seed: int, schema: pa.Schema):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = MinHasher(m, rows, seed)

        def one():
            for part in parts:
                for key, text in zip(part.column(0).to_pylist(), part.column(1)):
                    s = shingle_set(text.as_py(), size)
                    if len(s):
                        yield key, len(s), xxh3_128_digest(s.tobytes()), hasher.sketch(s).view(np.int64)
                    else:
                        yield key, 0, None, None

        yield from batches(one(), schema)

    return run


def histogram(shingles: np.ndarray) -> bytes:
    """Counts of the shingles by their low bits: the greatest power of two bins
    that the set fills.  Empty, which bounds nothing, if a count needs over a byte."""
    bins = 1 << (len(shingles).bit_length() - 1)
    counts = np.bincount((shingles & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def most_common(a: bytes, b: bytes) -> int | None:
    """An upper bound of the intersection of two sets by their histograms."""
    if not a or not b:
        return None
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):  # a bin of fewer bits is the sum of the bins with these low bits
        y = y.reshape(-1, len(x)).sum(axis=0, dtype=np.int64)
    return int(np.minimum(x, y).sum(dtype=np.int64))


def _sets(size: int, schema: pa.Schema):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one():
            for part in parts:
                for text in part.column(0):
                    s = shingle_set(text.as_py(), size)
                    if len(s):
                        yield xxh3_128_digest(s.tobytes()), histogram(s), s.view(np.int64)

        yield from batches(one(), schema, lambda r: r[2].nbytes)

    return run


def _possible(num: int, den: int, schema: pa.Schema):
    """Of rows (u, v, nu, nv, hu, hv) the pairs whose bound reaches the threshold."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes = (part.column(2).to_numpy() + part.column(3).to_numpy()).tolist()
            keep = []
            for n, a, b in zip(sizes, part.column(4).to_pylist(), part.column(5).to_pylist()):
                both = most_common(a, b)
                keep.append(both is None or both * (den + num) >= num * n)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0).filter(mask), part.column(1).filter(mask)], schema=schema)

    return run


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many of a set's first shingles, in any one order of all shingles, two
    sets at the threshold must have one of in common."""
    return n - (num * n + den - 1) // den + 1


def _bin_counts(schema: pa.Schema):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ORDER_BINS, np.int64)
        for part in parts:
            s = part.column(0).flatten().to_numpy().view(np.uint64)
            total += np.bincount((s % np.uint64(ORDER_BINS)).astype(np.int64), minlength=ORDER_BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=schema)

    return run


def _prefixes(counts: np.ndarray, num: int, den: int, schema: pa.Schema):
    """Rows (key, id, n, p): the shingles of each set's prefix and their places."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)

        held, size = [], 0
        for part in parts:
            for key, s in zip(part.column(0).to_pylist(), part.column(1)):
                s = s.values.to_numpy().view(np.uint64)
                n = len(s)
                first = np.lexsort((s, counts[(s % np.uint64(ORDER_BINS)).astype(np.int64)]))[: int(prefix_length(np.int64(n), num, den))]
                k = len(first)
                held.append((s[first].view(np.int64), np.full(k, key), np.full(k, n, np.int32), np.arange(k, dtype=np.int32)))
                size += 24 * k
                if size > BATCH_BYTES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def components(edges: DataFrame, stages: Stages) -> DataFrame:
    """``(v, label)`` for every endpoint of ``edges(u, v)``: label is the
    smallest node of its component.  Alternates large-star and small-star steps;
    a node's neighbours are only ever aggregated, never collected."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if large:
            least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
            out = both.where("v > u").join(least, "u").select(F.col("w").alias("u"), "v")
        else:
            down = both.where("v < u")
            least = down.groupBy("u").agg(F.min("v").alias("w"))
            out = down.join(least, "u").where("v != w").select(F.col("w").alias("u"), "v").union(least.select(F.col("w").alias("u"), F.col("u").alias("v")))
        return out.where("u != v").distinct()

    def print_of(e: DataFrame) -> tuple:
        h = F.xxhash64("u", "v")
        return tuple(e.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())

    e = stages.put(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u != v").distinct(), "edges", large=False)
    seen = print_of(e)
    while True:
        after = stages.put(star(star(e, True), False), "stars", large=False)
        now = print_of(after)
        stages.drop(e)
        e = after
        if now == seen:
            break
        seen = now
    return e.select("v", F.col("u").alias("label")).union(e.select(F.col("u").alias("v"), F.col("u").alias("label")).distinct())


class NearDuplicates:
    """Near-duplicate groups of a table.

    ``threshold`` is a fraction ``(num, den)``: two rows are linked when
    ``den * |intersection| >= num * |union|`` of their shingle sets.

    Defined results: null or wordless texts have no shingles and stay alone;
    repeated rows and equal texts share a component, whose id is the least
    non-null key in it (null only if all its keys are null); an empty table gives
    an empty result.  Only the key and text columns are read, so other columns
    may have any names.
    """

    def __init__(self, key: str = "doc_id", text: str = "text", *, shingle: int = 5, threshold: tuple[int, int] = (80, 100), rows: int = 3, miss: float = 5e-5, seed: int = 20260101):
        self.key, self.text, self.shingle, self.threshold, self.rows, self.seed = key, text, shingle, threshold, rows, seed
        self.m = sketches_per_collection(threshold[0] / threshold[1], rows, miss)

    def __call__(self, df: DataFrame) -> DataFrame:
        """``(key, n_shingles, component_id)`` for every row."""
        stages = Stages(df.sparkSession, "near")
        kind = df.schema[self.key].dataType
        docs = df.select(F.col(self.key).alias("k"), F.col(self.text).alias("t"))
        ddl = f"k {kind.simpleString()}, n long, cls binary, sig array<long>"
        arrow = pa.schema([("k", _arrow(kind)), ("n", pa.int64()), ("cls", pa.binary()), ("sig", pa.list_(pa.int64()))])
        rows = stages.put(docs.mapInArrow(_signatures(self.shingle, self.m, self.rows, self.seed, arrow), ddl), "rows")
        classes = rows.where("cls is not null").groupBy("cls").agg(F.min("k").alias("root"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        # an id is a number here: it is written, and read from there ever after
        classes = stages.put(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
        member = stages.put(self._buckets(classes.select("id", "sig"), stages), "buckets")
        links = self._links(docs, classes, member, stages)
        whole = classes.select("id", "cls", "root")
        if links is not None:
            label = components(links, stages).withColumnRenamed("v", "id")
            near = stages.put(label.join(whole.select("id", "root"), "id"), "labels")
            near = near.join(near.groupBy("label").agg(F.min("root").alias("c")), "label").select("id", "c")
            near = near.withColumn("linked", F.lit(True))
            whole = whole.join(near, "id", "left").select("cls", F.when(F.col("linked"), F.col("c")).otherwise(F.col("root")).alias("c"))
        else:
            whole = whole.select("cls", F.col("root").alias("c"))
        return rows.drop("sig").join(whole, "cls", "left").select(F.col("k").alias(self.key), F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("k")).otherwise(F.col("c")).alias("component_id"))

    def _buckets(self, classes: DataFrame, stages: Stages) -> DataFrame:
        """``(key, id)``: tables' buckets of two classes or more; of buckets
        with the same members only one stays."""
        single = classes.select("id", F.posexplode("sig").alias("i", "h"))
        again = single.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
        kept = stages.put(single.select("id", "h", (F.col("i") < self.m).alias("a")).join(again, "h", "left_semi"), "sketches")
        marks = _same_members(kept, "h", F.first("a").alias("a")).groupBy("c", "x", "y", "a").agg(F.min("h").alias("h")).select("h")
        kept = kept.join(marks, "h", "left_semi").groupBy("id").agg(F.collect_list(F.struct("a", "h")).alias("s"))
        half = lambda test: F.transform(F.filter("s", test), lambda x: x["h"])
        both = kept.select("id", half(lambda x: x["a"]).alias("a"), half(lambda x: ~x["a"]).alias("b"))
        pairs = both.select("id", F.explode("a").alias("a"), "b").select("id", "a", F.explode("b").alias("b"))
        keyed = stages.put(pairs.select(F.xxhash64("a", "b").alias("key"), "id"), "keys")
        one = _same_members(keyed, "key").where("c > 1").groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key")
        return keyed.join(one, "key", "left_semi")

    def _links(self, docs: DataFrame, classes: DataFrame, member: DataFrame, stages: Stages) -> DataFrame | None:
        """``(u, v)``: links enough for the components of all, None for none."""
        if member.isEmpty():
            return None
        sizes = classes.select("id", "n")
        act = stages.put(member.join(sizes, "id"), "members")
        sets = self._all_sets(docs, classes.join(member.select("id").distinct(), "id", "left_semi"), stages)
        # one pivot a bucket, by an aggregation
        lead = act.groupBy("key").agg(F.min("id").alias("pid"), F.min_by("n", "id").alias("pn"))
        met = act.join(lead, "key").where(F.col("id") != F.col("pid"))
        links = self._compare(met, sets, stages)
        labels = self._labels(links, stages)
        rest = met.select("key", "id").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        open_ = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
        ids = stages.put(rest.join(open_, "key", "left_semi").select("id").distinct(), "open")
        if ids.isEmpty():
            return links
        act = self._prefix_buckets(sets.join(ids, "id", "left_semi").select("id", "s"), stages)
        act = stages.put(act.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")), "active")
        pivots = FIRST_PIVOTS
        while True:
            open_ = act.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("key")
            after = stages.put(act.join(open_, "key", "left_semi"), "active")
            stages.drop(act)
            act = after
            if act.isEmpty():
                return links
            order = Window.partitionBy("key").orderBy("n", "id")
            lead = stages.put(act.withColumn("r", F.row_number().over(order)).where(F.col("r") <= pivots).drop("r"), "pivots", large=False)
            lead = lead.select("key", F.col("id").alias("pid"), F.col("n").alias("pn"), F.col("p").alias("pp"), F.col("label").alias("pl"))
            # the first common shingle's place bounds what can still be common
            room = F.least(F.col("n") - F.col("p"), F.col("pn") - F.col("pp"))
            num, den = self.threshold
            met = act.join(lead, "key").where((F.col("label") != F.col("pl")) & (room * (den + num) >= num * (F.col("n") + F.col("pn"))))
            found = self._compare(met, sets, stages)
            rest = act.join(lead.select("key", F.col("pid").alias("id")), ["key", "id"], "left_anti")  # a pivot's links are all known now
            if not found.isEmpty():
                links = links.union(found)
                rest = rest.drop("label").join(self._labels(links, stages), "id", "left").withColumn("label", F.coalesce("label", "id"))
            after = stages.put(rest, "active")
            stages.drop(act)
            act = after
            pivots *= 4

    @staticmethod
    def _labels(links: DataFrame, stages: Stages) -> DataFrame:
        return stages.put(components(links, stages), "labels", large=False).withColumnRenamed("v", "id")

    def _all_sets(self, docs: DataFrame, need: DataFrame, stages: Stages) -> DataFrame:
        """``(id, h, s)``: histogram and shingles of the needed classes."""
        roots = need.select("root").distinct()
        texts = docs.join(roots, docs["k"].eqNullSafe(roots["root"]), "left_semi").select("t")
        arrow = pa.schema([("cls", pa.binary()), ("h", pa.binary()), ("s", pa.list_(pa.int64()))])
        # texts under one key, and copies, have a class as well: each class once
        made = texts.mapInArrow(_sets(self.shingle, arrow), "cls binary, h binary, s array<long>")
        return stages.put(made.join(need.select("cls", "id"), "cls").select("id", "h", "s").dropDuplicates(["id"]), "sets")

    def _compare(self, met: DataFrame, sets: DataFrame, stages: Stages) -> DataFrame:
        """The links among the pairs (id, pid) that met; n and pn are their sizes."""
        num, den = self.threshold
        near = F.least("n", "pn") * den >= F.greatest("n", "pn") * num
        pairs = met.where(near & (F.col("id") != F.col("pid"))).select(F.least("id", "pid").alias("u"), F.greatest("id", "pid").alias("v")).distinct()
        marks = lambda a, b: sets.select(F.col("id").alias(a), F.size("s").alias(f"n{b}"), F.col("h").alias(f"h{b}"))
        wide = pairs.join(marks("u", "u"), "u").join(marks("v", "v"), "v").select("u", "v", "nu", "nv", "hu", "hv")
        possible = stages.put(wide.mapInArrow(_possible(num, den, pa.schema([("u", pa.int64()), ("v", pa.int64())])), "u long, v long"), "possible")
        x = sets.select(F.col("id").alias("u"), F.col("s").alias("su"))
        y = sets.select(F.col("id").alias("v"), F.col("s").alias("sv"))
        both = F.size(F.array_intersect("su", "sv"))
        found = possible.join(x, "u").join(y, "v").where(both * den >= (F.size("su") + F.size("sv") - both) * num).select("u", "v")
        return stages.put(found, "links")

    def _prefix_buckets(self, sets: DataFrame, stages: Stages) -> DataFrame:
        """``(key, id, n, p)``: shingles that are in two prefixes or more, with
        the sets' sizes and the shingle's place."""
        num, den = self.threshold
        counted = sets.select("s").mapInArrow(_bin_counts(pa.schema([("b", pa.int64()), ("c", pa.int64())])), "b long, c long")
        counts = np.zeros(ORDER_BINS, np.int64)
        found = counted.groupBy("b").agg(F.sum("c").alias("c")).toArrow()  # at most ORDER_BINS rows
        counts[found.column(0).to_numpy()] = found.column(1).to_numpy()
        arrow = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("p", pa.int32())])
        rows = stages.put(sets.mapInArrow(_prefixes(counts, num, den, arrow), "key long, id long, n int, p int"), "prefixes")
        # of buckets with the same members the one with the first places bounds best
        one = _same_members(rows, "key", F.min("p").alias("p")).where("c > 1").groupBy("c", "x", "y").agg(F.min(F.struct("p", "key")).alias("key")).select("key.key")
        return rows.join(one, "key", "left_semi")


def _same_members(rows: DataFrame, key: str, *more) -> DataFrame:
    """``(key, c, x, y)``: size and fingerprint of the ids under each key."""
    return rows.groupBy(key).agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("y"), *more)


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The table with one row of each near-duplicate group: the one with the least
    key, null last, and of different texts under one key the one with the least
    hash.  Rows that equal each other in key and text are one.  Texts are shuffled
    once, by a hash of key and text, copies combined before."""
    names = [f"c{i}" for i in range(len(df.columns))]
    inner = df.toDF(*names)
    k, t = F.col(names[df.columns.index(key)]), F.col(names[df.columns.index(text)])
    mark = [F.xxhash64(F.lit(seed), F.coalesce(k.cast("string"), F.lit("\0")), F.coalesce(t, F.lit("\0"))) for seed in (3, 5)]
    marked = inner.withColumn("h", mark[0]).withColumn("i", mark[1])
    row = F.struct(k.isNull().alias("n"), k.alias("k"), F.col("h"), F.col("i"))
    groups = NearDuplicates("row", "t", **options)(marked.select(row.alias("row"), t.alias("t")))
    kept = groups.where("row <=> component_id").select("row.h", "row.i").distinct()
    return marked.dropDuplicates(["h", "i"]).join(kept, ["h", "i"], "left_semi").select(*[F.col(n).alias(c) for n, c in zip(names, df.columns)])


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = NearDuplicates(threshold=(85, 100))(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
