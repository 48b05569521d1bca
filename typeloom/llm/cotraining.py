"""Quality by co-training of a text view and a metadata view.

The text view is naive Bayes over what the text says (its words, hashed into a
table of 65,536 weights) and how it looks (binned statistics);
the metadata view is naive Bayes over language, source and their pair, by actual
value, and over how much of it is missing.  Neither sees the other's columns.

In every round both views are calibrated on labelled rows that neither has
learned from; each then labels the rows it is confident about, and the *other*
one learns from them together with the labelled rows.  At the end both calibrated
views are combined as independent evidence.

A text model is a table of weighted counts of fixed size, so a round is one
aggregation over all rows.  Metadata values have a grouped table of log-odds that
is joined back, in which a rare value stays near 0.  Texts are read once; rounds
run on rows of some hundred bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, batches, read, word_hashes, words
from .quality_rules import STATS, text_stats

BINS = 16
#: Bin edges of the text features, fixed so that a bin means the same everywhere.
_RATIO = np.array([0, 0.002, 0.005, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.3, 0.45, 0.6, 0.75, 0.9, 0.97])
_SIZE = np.array([1, 5, 10, 20, 40, 80, 150, 300, 500, 800, 1500, 3000, 6000, 12000, 30000], float)
_MEAN = np.array([1, 2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 7, 8, 10, 14, 25], float)
TEXT = ("words", "word_length", "symbols", "duplicate_lines", "repeats", "letters", "upper", "digits", "distinct", "longest", "stops", "commas", "shouts", "bars", "short_lines", "quotes")
META = ("missing",)
#: Metadata that counts by value: language, source, and both; and the weight of
#: a value's prior, which one of that many labels outweighs by half.
VALUES, PRIOR = ("l", "s", "p"), 4.0
#: Weights of the words, and the prior of each.
WORDS, WORD_PRIOR = 1 << 16, 2.0
#: Values that a partition sums before it passes them on.
HELD = 50_000
#: Values up to this number are broadcast (some 100 bytes each); beyond it, rows
#: of one value are spread over so many parts of the join.
BROADCAST_VALUES, PARTS = 100_000, 64


def text_bins(text: str | None) -> bytes:
    """The bin of each ``TEXT`` feature."""
    s = dict(zip(STATS, text_stats(text)))
    t = text or ""
    n, chars, lines = s["n_words"] or 1, s["word_chars"] or 1, s["n_lines"] or 1
    values = (
        (s["n_words"], _SIZE), (chars / n, _MEAN), (s["n_symbols"] / n, _RATIO), (s["n_dup_lines"] / lines, _RATIO), (s["n_repeat_words"] / n, _RATIO), (s["n_letters"] / chars, _RATIO),
        (s["n_upper"] / (s["n_letters"] or 1), _RATIO), (s["n_digits"] / chars, _RATIO), (s["n_varied"] / n, _RATIO), (s["longest"], _SIZE), (t.count(".") / n, _RATIO), (t.count(",") / n, _RATIO),
        (t.count("!") / n, _RATIO), (t.count("|") / n, _RATIO), (lines / n, _RATIO), ((t.count('"') + t.count("'")) / n, _RATIO),
    )
    return bytes(int(np.searchsorted(edges, v, side="right")) for v, edges in values)


def text_words(text: str | None) -> bytes:
    """The hashed words that a text has, as 16-bit numbers."""
    return np.unique(word_hashes(words(text)) >> np.uint64(48)).astype(np.uint16).tobytes()


def _features(schema: pa.Schema):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one():
            for part in parts:
                for key, text, lang, source in zip(part.column(0).to_pylist(), part.column(1), *(part.column(i).to_pylist() for i in (2, 3))):
                    t = text.as_py()
                    pair = None if lang is None or source is None else f"{lang}\0{source}"
                    yield key, text_bins(t), text_words(t), bytes(((lang is None) + (source is None),)), lang, source, pair

        yield from batches(one(), schema, lambda r: len(r[2]))

    return run


class View:
    """Log-odds of quality from bins, by naive Bayes with add-one smoothing.  The
    mean over features, not the sum, is what confidence is asked of: features of
    one text repeat each other.  ``extra`` are log-odds of values without bins."""

    def __init__(self, counts: np.ndarray):  # (2, features, BINS)
        c = counts + 1.0
        p = c / c.sum(axis=2, keepdims=True)
        self.table = np.log(p[1]) - np.log(p[0])
        n = counts[:, 0].sum(axis=1) + 1
        self.prior = float(np.log(n[1] / n[0]))
        self.words = np.zeros(WORDS, np.float32)

    def with_words(self, counts: np.ndarray, n: np.ndarray) -> "View":
        """Adds log-odds of words, from the rows of each class that have them and
        all its rows; what was never seen stays at 0."""
        share = WORD_PRIOR * (n + 1) / (n.sum() + 2)
        c = counts.reshape(2, -1)
        self.words = (np.log(c[1] + share[1]) - np.log(c[0] + share[0]) - np.log(share[1] / share[0])).astype(np.float32)
        return self

    def odds(self, bins: np.ndarray, extra: np.ndarray | float = 0.0) -> np.ndarray:
        return self.table[np.arange(bins.shape[1]), bins].sum(axis=1) + self.prior + extra

    def of_words(self, found: "Words") -> np.ndarray:
        """The words' log-odds of each row: their sum over the root of their
        number, as words of one text repeat each other."""
        total = np.bincount(found.row, self.words[found.at], len(found.size))
        return total / np.sqrt(np.maximum(found.size, 1))


class Words:
    """Words of a batch: ``at`` and ``row`` of each, ``size`` of each row."""

    def __init__(self, column: pa.Array):
        raw = column.to_pylist()
        self.size = np.fromiter(map(len, raw), np.int64, len(raw)) // 2
        self.at = np.frombuffer(b"".join(raw), np.uint16).astype(np.int64)
        self.row = np.repeat(np.arange(len(raw)), self.size)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(-1, width)


def _odds(views: tuple[View, View], part: pa.RecordBatch, found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Both views' log-odds of rows (t, w, m, o, ...)."""
    return views[0].odds(matrix(part.column(0), len(TEXT)), views[0].of_words(found)), views[1].odds(matrix(part.column(2), len(META)), part.column(3).to_numpy(zero_copy_only=False))


_COUNTS = pa.schema([("view", pa.int32()), ("at", pa.int32()), ("value", pa.string()), ("w", pa.float64())])


def _counts(views: tuple[View, View] | None, scale: list[tuple[float, float]], sure: float, weight: float):
    """Rows (view, at, value, w) of one partition's weighted counts: views 0 and
    1 by class, feature and bin; 2 by class and word; those from 3 on are those of
    ``VALUES``, with the class and the value."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((2, len(f), BINS)) for f in (TEXT, META)] + [np.zeros((2, WORDS))]
        held: dict[tuple[int, int, str | None], float] = {}

        def values() -> pa.RecordBatch:
            view, at, value = zip(*held)
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((view, at, value, held.values()), _COUNTS)], schema=_COUNTS)
            held.clear()
            return out

        for part in parts:
            found = Words(part.column(1))
            bins = [matrix(part.column(0), len(TEXT)), matrix(part.column(2), len(META))]
            label = np.array([-1 if v is None else v for v in part.column(4).to_pylist()])
            odds = [a * o + b for o, (a, b) in zip(_odds(views, part, found), scale)] if views else None
            for k in (0, 1):
                y, w = label.copy(), (label >= 0).astype(float)
                if odds:  # the other view's confident rows
                    other = odds[1 - k]
                    new = (label == -1) & (np.abs(other) >= sure)
                    y[new], w[new] = other[new] > 0, weight
                for c in (0, 1):
                    mine = (y == c) & (w > 0)
                    for j in range(bins[k].shape[1]):
                        total[k][c, j] += np.bincount(bins[k][mine, j], w[mine], BINS)
                    if k == 0:
                        has = mine[found.row]
                        total[2][c] += np.bincount(found.at[has], w[found.row[has]], WORDS)
                    else:
                        for i, column in enumerate(part.columns[5:]):
                            codes = column.dictionary_encode(null_encoding="encode")
                            sums = np.bincount(codes.indices.to_numpy()[mine], w[mine], len(codes.dictionary))
                            for v, x in zip(codes.dictionary.to_pylist(), sums):
                                if x:
                                    held[3 + i, c, v] = held.get((3 + i, c, v), 0.0) + x
            if len(held) > HELD:
                yield values()
        if held:
            yield values()
        for k, t in enumerate(total):
            at = np.flatnonzero(t.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.nulls(len(at), pa.string()), pa.array(t.ravel()[at])], schema=_COUNTS)

    return run


def platt(odds: np.ndarray, y: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of calibrated log-odds, by Newton steps; a slope below 0,
    or no data, means that the view says nothing beyond the prior."""
    if w.sum() < 10 or not (w[y == 1].sum() and w[y == 0].sum()):
        return 0.0, prior
    x, b = np.stack([odds, np.ones(len(odds))], axis=1), np.array([0.1, prior])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (y - p)) - 1e-2 * np.array([b[0], 0])
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(h, g)
        b = b + step
        if abs(step).max() < 1e-8:
            break
    return (float(b[0]), float(b[1])) if b[0] > 0 else (0.0, prior)


def _buckets(views: tuple[View, View], step: float):
    """Rows (view, y, b) of labelled rows' log-odds, in steps."""
    schema = pa.schema([("view", pa.int32()), ("y", pa.int32()), ("b", pa.int32())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            y = np.array(part.column(4).to_pylist(), np.int32)
            for k, o in enumerate(_odds(views, part, Words(part.column(1)))):
                o = np.clip(o, -60, 60)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), k, np.int32)), pa.array(y), pa.array(np.round(o / step).astype(np.int32))], schema=schema)

    return run


def _scores(views: tuple[View, View], scale: list[tuple[float, float]], prior: float, schema: pa.Schema):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        for part in parts:
            z = [a * o + b for o, (a, b) in zip(_odds(views, part, Words(part.column(1))), scale)]
            cols = [part.column(4), *(pa.array(sigmoid(x)) for x in (z[0], z[1], z[0] + z[1] - prior))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


class CoTraining:
    """Quality probability of every row from two views.

    ``sure`` is the calibrated probability from which a view's opinion becomes a
    pseudo-label, of the weight ``weight``.

    Defined results: null texts, languages and sources have bins of their own; a
    key with several labels counts with its lowest (a tie of opinions is no
    quality); without labels every probability is the prior, one half; repeated
    rows get equal results; very long texts are read whole; an empty table gives
    an empty result.  Of ``labels``, a fifth of the keys (by crc32 of the key)
    calibrates and is not learned from, another fifth is for the caller's
    measurement only.
    """

    def __init__(self, key: str = "doc_id", text: str = "text", meta: tuple[str, str] = ("lang", "source"), *, rounds: int = 3, sure: float = 0.95, weight: float = 0.25, least: float = 0.5):
        self.key, self.text, self.meta, self.rounds, self.sure, self.weight, self.least = key, text, meta, rounds, sure, weight, least

    def __call__(self, df: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
        """``(key, text_prob, meta_prob, quality_prob, kept)`` for every row."""
        from pyspark.sql.pandas.types import to_arrow_type

        stages = Stages(df.sparkSession, "cotraining")
        kind = df.schema[self.key].dataType
        binaries, strings = ("t", "w", "m"), ("l", "s", "p")
        schema = pa.schema([("k", to_arrow_type(kind)), *((c, pa.binary()) for c in binaries), *((c, pa.string()) for c in strings)])
        ddl = f"k {kind.simpleString()}, " + ", ".join([f"{c} binary" for c in binaries] + [f"{c} string" for c in strings])
        lang, source = self.meta
        rows = df.select(F.col(self.key).alias("k"), F.col(self.text).alias("x"), F.col(lang).cast("string").alias("l"), F.col(source).cast("string").alias("s"))
        rows = rows.mapInArrow(_features(schema), ddl)
        known = labels.where(F.col(label).isin(0, 1) & F.col(self.key).isNotNull()).groupBy(F.col(self.key).alias("k")).agg(F.min(label).cast("int").alias("y"))
        fold = F.crc32(F.col("k").cast("string").cast("binary")) % 5
        # held-out rows must not be pseudo-labelled either: they get no part in learning
        # features are written once, with the labels beside them; labels grow with
        # the table, so they are never broadcast
        joined = stages.put(rows.join(known.hint("merge"), "k", "left").withColumn("fold", F.when(F.col("y").isNotNull(), fold)), "features")
        learn = joined.where("fold is null or fold >= 2")
        views, values, scale, prior = None, None, [], 0.0
        for _ in range(1 + self.rounds):
            views, values = self._learn(stages, learn, views, values, scale)
            scale, prior = self._calibrate(self._with_odds(joined.where("fold = 1"), values), views)
        out = pa.schema([("k", to_arrow_type(kind)), ("text_prob", pa.float64()), ("meta_prob", pa.float64()), ("quality_prob", pa.float64())])
        scored = self._with_odds(joined, values).select("t", "w", "m", "o", "k").mapInArrow(_scores(views, scale, prior, out), f"k {kind.simpleString()}, text_prob double, meta_prob double, quality_prob double")
        return scored.withColumn("kept", F.col("quality_prob") >= self.least).withColumnRenamed("k", self.key)

    @staticmethod
    def _with_odds(rows: DataFrame, values: DataFrame | None) -> DataFrame:
        """Rows with ``o``, the log-odds of their values; 0 for one never learned."""
        odds = F.lit(0.0)
        if values is not None:
            few = values.count() <= BROADCAST_VALUES
            for i, c in enumerate(VALUES):
                one = values.where(F.col("view") == 3 + i).select(F.col("value").alias(f"_{c}"), F.col("odds").alias(f"_o{c}"))
                same = rows[c].eqNullSafe(one[f"_{c}"])
                if few:
                    rows = rows.join(F.broadcast(one), same, "left")
                else:
                    spread = rows.withColumn(f"_p{c}", F.pmod(F.xxhash64("w", "t", F.lit(i)), F.lit(PARTS)))
                    every = one.withColumn(f"_q{c}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
                    rows = spread.join(every, spread[c].eqNullSafe(every[f"_{c}"]) & (spread[f"_p{c}"] == every[f"_q{c}"]), "left")
                odds = odds + F.coalesce(f"_o{c}", F.lit(0.0))
        return rows.withColumn("o", odds)

    def _learn(self, stages: Stages, rows: DataFrame, views: tuple[View, View] | None, values: DataFrame | None, scale: list[tuple[float, float]]) -> tuple[tuple[View, View], DataFrame]:
        sure = float(np.log(self.sure / (1 - self.sure)))
        inputs = self._with_odds(rows, values).select("t", "w", "m", "o", "y", *VALUES)
        parts = inputs.mapInArrow(_counts(views, scale, sure, self.weight), "view int, at int, value string, w double")
        counts = stages.put(parts.groupBy("view", "at", "value").agg(F.sum("w").alias("w")), "counts")
        total = [np.zeros(2 * len(f) * BINS) for f in (TEXT, META)] + [np.zeros(2 * WORDS)]
        found = counts.where("view <= 2").select("view", "at", "w").toArrow()  # one row a count of the model
        view, at, w = (found.column(i).to_numpy() for i in range(3))
        for k, t in enumerate(total):
            t[at[view == k]] = w[view == k]
        learned = tuple(View(t.reshape(2, -1, BINS)) for t in total[:2])
        learned[0].with_words(total[2], total[0].reshape(2, -1, BINS)[:, 0].sum(axis=1))
        # odds of the value over those of all rows, both classes with a share of the prior
        n = total[1].reshape(2, -1).sum(axis=1) + 1
        of = lambda c: F.sum(F.when(F.col("at") == c, F.col("w")).otherwise(0.0)) + float(PRIOR * n[c] / n.sum())
        values = counts.where("view > 2").groupBy("view", "value").agg((F.log(of(1)) - F.log(of(0)) - float(np.log(n[1] / n[0]))).alias("odds"))
        return learned, stages.put(values, "values")

    def _calibrate(self, rows: DataFrame, views: tuple[View, View]) -> tuple[list[tuple[float, float]], float]:
        step = 0.25
        found = rows.select("t", "w", "m", "o", "y").mapInArrow(_buckets(views, step), "view int, y int, b int").groupBy("view", "y", "b").count().collect()  # at most 2 * 2 * 481 rows
        n = [sum(r["count"] for r in found if r.view == 0 and r.y == c) for c in (0, 1)]
        prior = float(np.log((n[1] + 1) / (n[0] + 1)))
        scale = []
        for k in (0, 1):
            mine = sorted((r.b, r.y, r["count"]) for r in found if r.view == k)
            b, y, w = (np.array(c, float) for c in zip(*mine)) if mine else (np.zeros(0),) * 3
            scale.append(platt(b * step, y, w, prior))
        return scale, prior


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CoTraining()(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
