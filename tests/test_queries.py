"""Every registered query against its SQL on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__
from typeloom import queries as engine
from typeloom.plans.xsd import compile_text
from typeloom.sources import reports
from typeloom.sources.structs import schema_to_struct

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_query_equals_sql(spark, sf, con, name):
    df = engine.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(engine.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(str(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert got == want


def test_queries_without_sql(spark, sf):
    for name in set(engine.QUERIES) - set(engine.SQL):
        assert engine.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_expectations_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", "pass"), ("a", "fail")], "case string, status string")
    reports.write_expectations(df, str(tmp_path / "e"))
    assert sorted(map(tuple, reports.read_expectations(spark, str(tmp_path / "e")).collect())) == [("a", "fail"), ("b", "pass")]
    assert reports.unknown_rules(spark.createDataFrame([("cvc-elt",), ("none",)], "rule string")).first().rule == "none"


def test_struct_of_a_schema():
    t = schema_to_struct(compile_text(engine.SHOP), ("", "order"))
    assert t["line"].dataType.elementType["_part"].dataType.simpleString() == "string" and "_status" in t.fieldNames()


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    shutil.copytree(f"{root}/typeloom", tmp_path / "typeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), len(e.oracle_sql()))"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 40
    # the rest's tests are all collected there, and some of them run
    shutil.copytree(f"{root}/tests", tmp_path / "tests", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    run = lambda *args: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *args], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert run("--collect-only", "tests").returncode == 0
    done = run("tests/test_sources.py", "tests/test_queries.py::test_entry", "tests/test_queries.py::test_expectations_round_trip")
    assert done.returncode == 0, done.stdout[-2000:]


def test_digits_of_every_order(spark, sf):
    got = {r.rule: r.n for r in engine.QUERIES["facet_digits"](spark, sf).collect()}
    assert sum(got.values()) == engine.table(spark, sf, "orders").count()
    assert got["ok"] > 0


def test_double_of_every_discount(spark, sf):
    got = {r.canonical: r.n for r in engine.QUERIES["canonical_double"](spark, sf).collect()}
    assert sum(got.values()) == engine.table(spark, sf, "lineitem").count()
    assert got["1.0E-1"] > 0
