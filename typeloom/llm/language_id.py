"""Language identification by compression.

Per language, text of labelled rows forms a zstandard raw-content dictionary.
A text is lower-cased, cut into pieces, and each piece is compressed with every
dictionary; the language with the least sum of sizes wins.  Pieces keep the
dictionary in use on long texts, where a compressor would otherwise learn the
language from the text itself.  Where the margin to the second language is
narrow the result is rejected.

Only the dictionaries are driver state: at most ``per_language`` snippets of
``snippet`` characters for each language, chosen by a hash of the text, whatever
the size of the table and of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, read


class Compressors:
    """One compressor per language; a picklable description builds them on an
    executor."""

    def __init__(self, dictionaries: dict[str, bytes], level: int, piece: int, order: list[str] | None = None):
        self.dictionaries, self.level, self.piece = dictionaries, level, piece
        self.order = order or sorted(dictionaries)
        self.made = None

    def __getstate__(self):
        return self.dictionaries, self.level, self.piece, self.order

    def __setstate__(self, state):
        self.dictionaries, self.level, self.piece, self.order = state
        self.made = None

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of a text with each dictionary, in ``order``."""
        if self.made is None:
            self.made = []
            for name in self.order:
                d = zstandard.ZstdCompressionDict(self.dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self.made.append(zstandard.ZstdCompressor(dict_data=d, level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        raw = f" {text.lower()} ".encode()  # a word at an end matches like one inside
        out = [0] * len(self.made)
        for i in range(0, len(raw), self.piece):
            part = raw[i : i + self.piece]
            for k, compress in enumerate(self.made):
                out[k] += len(compress(part))
        return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


class LanguageId:
    """Predicts the language of every row of a table.

    Defined results: ``und`` with score 0 and rejected for a null text, one
    without letters, and for all rows if no labelled row was given; ties go to
    the language with more labelled rows, then the first by name; repeated rows
    get equal results; an empty table gives an empty result.  The score is the
    margin, (second - best) / second; with one language it is 1.
    """

    def __init__(self, key: str = "doc_id", text: str = "text", lang: str = "lang", *, per_language: int = 256, snippet: int = 600, level: int = 6, piece: int = 1024, margin: float = 0.01):
        self.key, self.text, self.lang = key, text, lang
        self.per_language, self.snippet, self.level, self.piece, self.margin = per_language, snippet, level, piece, margin

    def fit(self, labelled: DataFrame) -> Compressors:
        """Dictionaries from the texts with the least hashes per language.  A text
        that many rows have counts once, so copies cannot fill a dictionary."""
        t = F.col(self.text)
        rows = labelled.where(F.col(self.lang).isNotNull() & (F.length(t) > 0)).select(F.col(self.lang).alias("lang"), F.xxhash64(t, F.lit(11)).alias("h"), F.substring(t, 1, 3 * self.snippet).alias("s"))
        distinct = rows.groupBy("lang", "h").agg(F.count("*").alias("n"))
        counts = {r.lang: r.n for r in distinct.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        order = Window.partitionBy("lang").orderBy("h")
        picked = distinct.withColumn("r", F.row_number().over(order)).where(F.col("r") <= self.per_language).select("lang", "h")
        snippets = rows.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "h").agg(F.min("s").alias("s"))
        found: dict[str, list[str]] = {}
        for r in snippets.orderBy("lang", "h").collect():  # per_language rows a language
            start = len(r.s) // 3 if len(r.s) >= 3 * self.snippet else 0
            found.setdefault(r.lang, []).append(r.s[start : start + self.snippet].lower())
        return Compressors({k: "\n".join(v).encode() for k, v in found.items()}, self.level, self.piece, sorted(found, key=lambda k: (-counts[k], k)))

    def predict(self, df: DataFrame, model: Compressors) -> DataFrame:
        """The table with ``lang_pred``, ``score`` and ``rejected`` appended,
        under inner names ``c0``, ``c1`` ... for its own columns."""
        from pyspark.sql.pandas.types import to_arrow_schema

        names = [f"c{i}" for i in range(len(df.columns))]
        kinds = [f.dataType.simpleString() for f in df.schema]
        schema = pa.schema([pa.field(n, f.type) for n, f in zip(names, to_arrow_schema(df.schema))] + [("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
        ddl = ", ".join(f"{n} {k}" for n, k in zip(names, kinds)) + ", lang_pred string, score double, rejected boolean"
        return df.toDF(*names).mapInArrow(_run(model, df.columns.index(self.text), self.margin, schema), ddl)


def decide(model: Compressors, text: str | None, margin: float) -> tuple[str, float, bool]:
    names = model.order
    if not names or not has_letter(text):
        return "und", 0.0, True
    sizes = model.sizes(text)
    order = sorted(range(len(names)), key=sizes.__getitem__)
    best = sizes[order[0]]
    score = 1.0 if len(names) == 1 else (sizes[order[1]] - best) / sizes[order[1]]
    return names[order[0]], score, score < margin


def _run(model: Compressors, column: int, margin: float, schema: pa.Schema):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [decide(model, t.as_py(), margin) for t in part.column(column)]
            own = [c.cast(f.type) for c, f in zip(part.columns, schema)]
            cols = [pa.array(x, f.type) for x, f in zip(zip(*found), list(schema)[len(own) :])] if found else [pa.array([], f.type) for f in list(schema)[len(own) :]]
            yield pa.RecordBatch.from_arrays(own + cols, schema=schema)

    return run


def learnable(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of which language models may learn: crc32 of the key as text is
    not divisible by 5."""
    return df.where(F.crc32(F.col(key).cast("string").cast("binary")) % 5 != 0)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    op = LanguageId()
    model = op.fit(learnable(docs))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    out = op.predict(docs.select("doc_id", "text", held.alias("held_out")), model)
    return out.select(F.col("c0").alias("doc_id"), F.col("c2").alias("held_out"), "lang_pred", "score", "rejected")
