"""The corpus pipeline: language, quality, near and exact duplicates, then packed
sequences.  Each stage works on all that the one before it kept, and returns the
columns of documents; the last returns pieces of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.llm.common import Stages, read
from typeloom.llm.language_id import LanguageId, learnable
from typeloom.llm.near_dedup import one_of_each
from typeloom.llm.packing import Packing
from typeloom.llm.quality_rules import QualityRules
from typeloom.llm.substring_dedup import SubstringDedup

#: Similarity of near duplicates.
THRESHOLD = (80, 100)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told with a margin: null texts, texts
    without letters and narrow decisions go."""
    op = LanguageId()
    found = op.predict(docs, op.fit(learnable(docs)))
    inner = found.where(~F.col("rejected")).drop("lang_pred", "score", "rejected")
    return inner.toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of probable quality that do not fail the base rules, each
    row by itself; an empty table stays empty."""
    return QualityRules().keep(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the
    least id, null last; of different texts under that id, one; of repeated rows,
    one.  Documents without words are in no group and stay."""
    return one_of_each(docs, threshold=THRESHOLD)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that repeat; ``n_chars`` follows the new text.  A
    document of which nothing is left goes, and so do null and empty texts;
    repeated rows repeat each other's passages.  An empty table stays empty."""
    out = SubstringDedup().remove(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).where(F.length("text") > 0).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of at most 1024 tokens; repeated rows are
    packed each, and an empty table gives no pieces."""
    return Packing()(docs)


STAGES = [("language", language), ("quality", quality), ("near_dedup", near), ("substring_dedup", substrings), ("packing", pack)]

#: No stage but the filters' last steps can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is a written table, and the next reads it."""
    tables = Stages(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = tables.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
