"""Single literals on the driver, for value constraints of schemas.

The same column expressions that judge data judge these, on one row, so a
literal in a schema and one in a table can never be told apart by two codes.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.facets import Undecided, check
from ..functions.types import SimpleType


@lru_cache(maxsize=10_000)
def check_literal(lexical: str, t: SimpleType) -> str | None:
    """The rule that a literal breaks, or None; without a session, or for a type
    that nothing governs, it is undecided and passes."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return None
    try:
        return spark.range(1).select(check(F.lit(lexical), t).alias("rule")).first()[0]
    except Undecided:
        return None
