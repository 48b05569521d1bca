"""Validation of streams: the same column expressions, and state where rows meet.

A row's verdict needs no state.  Uniqueness across rows holds within a watermark;
rule counts are windowed aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.facets import check
from ..functions.types import SimpleType


def checked(stream: DataFrame, columns: dict[str, SimpleType]) -> DataFrame:
    """``rule_<column>`` beside each column: the rule it breaks, or null."""
    return stream.withColumns({f"rule_{c}": check(F.col(c).cast("string"), t) for c, t in columns.items()})


def rule_counts(stream: DataFrame, columns: dict[str, SimpleType], time: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Violations by window, column and rule; rows later than ``late`` are out."""
    rules = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"rule_{c}").alias("rule")) for c in columns])
    found = checked(stream, columns).select(time, F.explode(rules).alias("x")).where("x.rule is not null").select(time, "x.name", "x.rule")
    return found.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "name", "rule").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "name", "rule", "n")


def unique(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
