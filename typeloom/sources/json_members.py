"""JSON members as typed literals: the scalars of a document, for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def members(df: DataFrame, key: str, json: str) -> DataFrame:
    """``(key, name, value)``: one row per top-level member, its value as text."""
    m = F.from_json(F.col(json), "map<string, string>")
    return df.select(F.col(key), F.explode(m).alias("name", "value"))
