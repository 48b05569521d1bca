"""Quality rules as weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0) on a text's statistics.  The
rules' accuracies on good and on bad texts, and the share of good texts, are
estimated by expectation-maximisation, without labels; the posterior probability
of quality replaces a filter that asks every rule to pass.

Statistics are computed in one Python pass per batch.  EM needs only how often
each combination of votes occurs, which Spark counts over all rows: at most
``3 ** len(RULES)`` combinations, whatever the size of the table, so the model
is fitted on the driver and joined back as a table of that bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, ngrams, read, word_hashes

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_digits", "n_varied", "longest", "n_bangs")
#: Words of a stretch in which different words are counted, so that the share of
#: different words means the same for a text of any length.
STRETCH = 100


def text_stats(text: str | None) -> tuple[int, ...]:
    """The statistics ``STATS`` of a text; all 0 for a null."""
    if not text:
        return (0,) * len(STATS)
    ws = text.encode().split()
    n = len(ws)
    word_chars = len(text) - sum(map(text.count, WHITE))
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = _kinds()[points]
    h = word_hashes(ws)
    return (n, word_chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(h), lines, int((kind & 1).sum()), int((kind >> 1 & 1).sum()), int((kind >> 2).sum()), varied_words(h), max(map(len, ws), default=0), text.count("!"))


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of every code point: 1 for a letter, and 2 for one of upper case; 4 for an ASCII digit."""
    kinds = np.fromiter((chr(c).isalpha() + 2 * chr(c).isupper() for c in range(0x110000)), np.uint8, 0x110000)
    kinds[48:58] = 4
    return kinds


def varied_words(h: np.ndarray, stretch: int = STRETCH) -> int:
    """Different words of each stretch of the sequence, summed over stretches."""
    whole = len(h) // stretch * stretch
    total = len(np.unique(h[whole:]))
    if whole:
        rows = np.sort(h[:whole].reshape(-1, stretch), axis=1)
        total += len(rows) + int((rows[:, 1:] != rows[:, :-1]).sum())
    return total


def repeated_words(h: np.ndarray, window: int = 8) -> int:
    """Words covered by windows that occur twice or more in the sequence."""
    g = ngrams(h, window)
    if len(g) < 2:
        return 0
    order = np.argsort(g, kind="stable")
    same = g[order[1:]] == g[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(g), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    at = np.flatnonzero(hit)
    cover = np.zeros(len(h) + 1, np.int64)
    cover[at] += 1
    cover[at + window] -= 1
    return int((np.cumsum(cover) > 0).sum())


def _run(column: int, carried: int, schema: pa.Schema):
    """Statistics of a text column beside the first ``carried`` columns."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = np.array([text_stats(t.as_py()) for t in part.column(column)], np.int64).reshape(-1, len(STATS))
            own = [part.column(i).cast(schema.field(i).type) for i in range(carried)]
            yield pa.RecordBatch.from_arrays(own + [pa.array(c) for c in found.T], schema=schema)

    return run


def _vote(value: Column, bad: Column, good: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.when(F.col(b) > 0, F.col(b))


def rules() -> dict[str, Column]:
    """The votes, on the columns ``STATS``.  A rule whose ratio has nothing to
    divide by abstains."""
    mean = _ratio("word_chars", "n_words")
    sym = _ratio("n_symbols", "n_words")
    lines = _ratio("n_dup_lines", "n_lines")
    rep = _ratio("n_repeat_words", "n_words")
    letters = (F.col("n_letters") + F.col("n_digits")) / F.when(F.col("word_chars") > 0, F.col("word_chars"))
    upper = _ratio("n_upper", "n_letters")
    bangs = _ratio("n_bangs", "n_words")
    variety = _ratio("n_varied", "n_words")
    return {
        "words": _vote(F.col("n_words"), F.col("n_words") < 20, F.col("n_words") >= 40),
        "word_length": _vote(mean, (mean < 2) | (mean > 14), (mean >= 3) & (mean <= 9)),
        "symbols": _vote(sym, sym > 0.15, sym < 0.03),
        "letters": _vote(letters, letters < 0.87, letters >= 0.92),
        "upper": _vote(upper, upper > 0.4, upper < 0.15),
        "bangs": _vote(bangs, bangs > 0.25, bangs < 0.05),
        "lines": _vote(lines, lines > 0.3, lines < 0.1),
        "repeats": _vote(rep, rep > 0.3, rep < 0.1),
        "variety": _vote(variety, variety < 0.25, variety >= 0.4),
        "longest": _vote(F.col("longest"), F.col("longest") > 400, (F.col("longest") <= 80) & (F.col("longest") > 0)),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tol: float = 1e-7) -> tuple[float, np.ndarray]:
    """Prior and accuracies by EM over distinct vote patterns and their counts.

    The accuracies are those of a rule on good and on bad texts, apart:
    ``acc[rule, y, v + 1]`` is the probability of vote v where the truth is y,
    so a rule that votes good on everything says nothing.  EM starts from rules
    whose bad votes are rare and telling; that start, as pseudo-counts, also
    stands for votes that never occur."""
    start = np.array([[0.25, 0.15, 0.6], [0.01, 0.09, 0.9]])
    acc = np.repeat(start[None], patterns.shape[1], axis=0)
    prior, total = 0.85, counts.sum()
    votes = [patterns == v for v in (-1, 0, 1)]
    for _ in range(rounds):
        p = posterior(patterns, prior, acc)
        weight = np.stack([counts * (1 - p), counts * p])
        new = np.stack([(weight @ v).T for v in votes], axis=2) + 2 * start
        new /= new.sum(axis=2, keepdims=True)
        new_prior = float((weight[1].sum() + 1.7) / (total + 2))
        done = abs(new - acc).max() < tol and abs(new_prior - prior) < tol
        prior, acc = new_prior, new
        if done:
            break
    return prior, acc


def weights(acc: np.ndarray) -> np.ndarray:
    """Log-odds that each rule's votes -1, 0 and 1 add."""
    return np.log(acc[:, 1]) - np.log(acc[:, 0])


def posterior(patterns: np.ndarray, prior: float, acc: np.ndarray) -> np.ndarray:
    w = weights(acc)
    z = np.log(prior / (1 - prior)) + w[np.arange(len(w)), patterns + 1].sum(axis=1)
    return 1 / (1 + np.exp(-z))


class QualityRules:
    """Posterior quality of every row.

    Defined results: a null or empty text has 0 in every statistic and its
    ratios abstain; ties of votes are settled by the prior; repeated rows get
    equal results; very long texts are read whole, by the same rules; an empty
    table gives an empty result.
    """

    def __init__(self, key: str = "doc_id", text: str = "text", *, least: float = 0.5):
        self.key, self.text, self.least = key, text, least

    def stats(self, df: DataFrame, carry: bool = False) -> DataFrame:
        """``(k, *STATS)``; with ``carry`` the table's own columns, under inner
        names ``c0``, ``c1`` ..., in place of ``k``."""
        from pyspark.sql.pandas.types import to_arrow_schema

        if carry:
            inner, column = df.toDF(*[f"c{i}" for i in range(len(df.columns))]), df.columns.index(self.text)
        else:
            inner, column = df.select(F.col(self.key).alias("k"), F.col(self.text).alias("t")), 1
        own = inner if carry else inner.select("k")
        schema = pa.schema(list(to_arrow_schema(own.schema)) + [(c, pa.int64()) for c in STATS])
        ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema) + "".join(f", {c} long" for c in STATS)
        return inner.mapInArrow(_run(column, len(own.columns), schema), ddl)

    def fit(self, stats: DataFrame) -> tuple[float, np.ndarray]:
        """Prior and accuracies from the votes of all rows."""
        votes = rules()
        # a combination of votes is a number in base 3
        code = sum(((v + 1) * 3**i for i, v in enumerate(votes.values())), F.lit(0)).cast("int")
        found = stats.groupBy(code.alias("code")).count().collect()  # at most 3 ** rules rows
        codes = np.array([r[0] for r in found], np.int64)
        patterns = np.stack([codes // 3**i % 3 - 1 for i in range(len(votes))], axis=1) if len(codes) else np.zeros((0, len(votes)), np.int64)
        return fit(patterns, np.array([r[1] for r in found], float))

    def score(self, stats: DataFrame, prior: float, acc: np.ndarray) -> DataFrame:
        """``quality``, ``base_failed`` and ``kept`` appended.  The log-odds are
        a sum over votes, so scoring needs no join."""
        odds = F.lit(float(np.log(prior / (1 - prior))))
        for v, (bad, none, good) in zip(rules().values(), weights(acc).tolist()):
            odds = odds + F.when(v < 0, bad).when(v > 0, good).otherwise(none)
        failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
        out = stats.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
        return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= self.least))

    def __call__(self, df: DataFrame) -> DataFrame:
        """``(k, *STATS, quality, base_failed, kept)`` for every row."""
        done = Stages(df.sparkSession, "rules").put(self.stats(df), "stats")
        return self.score(done, *self.fit(done))

    def keep(self, df: DataFrame) -> DataFrame:
        """The table's rows that are kept.  Statistics are computed twice, once
        to fit and once beside the row, so that no text is written or shuffled."""
        model = self.fit(self.stats(df))
        scored = self.score(self.stats(df, carry=True), *model).where("kept")
        return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = QualityRules()(read(spark, sf_dir, "documents"))
    return out.select(F.col("k").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
