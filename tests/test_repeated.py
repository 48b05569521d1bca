"""Counts by key and by literal."""

from pyspark.sql import functions as F

from typeloom import queries as engine
from typeloom.functions.types import BUILTINS as B
from typeloom.operators.identity import duplicates, repeated


def test_repeated_counts_the_duplicates(spark):
    rows = [(s, n, x, i) for i, (s, n, x) in enumerate([("a", 1, "1"), ("a", 1, "01"), ("a", 1, "1.0"), ("a", 2, "1"), ("b", 1, "1"), ("b", None, "1"), ("b", None, "1"), ("b", 3, "x"), ("b", 3, "x"), ("b", 4, " 2"), ("b", 4, "2")])]
    df = spark.createDataFrame(rows, "s string, n int, x string, i int")
    kinds = [B["int"], B["decimal"]]
    want = duplicates(df, ["n", "x"], ["i"], kinds, ["s"]).groupBy("s", "n").agg(F.count("*").alias("later"))
    got = repeated(df, ["n", "x"], kinds, ["s"])
    assert got.columns == ["s", "n", "x", "later"]
    assert sorted(map(str, got.select("s", "n", "later").collect())) == sorted(map(str, want.collect()))
    assert {(r.n, r.x, r.later) for r in got.collect()} == {(1, "01", 2), (4, " 2", 1)}


def test_unique_pair_joins_nothing(spark, sf):
    plan = engine.QUERIES["unique_pair"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Relation") == 1


def test_each_different_duration_is_worked_out_once(spark, sf):
    plan = engine.QUERIES["canonical_duration"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    # from the top: sums, canonical forms, counts by literal
    kinds = [x.split("Aggregate")[0].strip(" +-") == "" for x in plan if "Aggregate" in x]
    assert len(kinds) == 2 and "regexp" not in plan[-1] + plan[-2].lower() and any("rlike" in x.lower() or "regexp" in x.lower() for x in plan[:-2])
    assert "[d#" in [x for x in plan if "Aggregate" in x][1]
