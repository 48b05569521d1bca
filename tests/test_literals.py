"""Datatypes, facets and patterns against vectors and exact arithmetic."""

import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from typeloom.functions import values as V
from typeloom.functions.facets import Undecided, canonical, check, key, matches_fixed, verdict
from typeloom.functions.patterns import PatternError, translate
from typeloom.functions.types import ANY_ATOMIC, BUILTINS, ERROR, SimpleType, list_of, restrict, union_of

B = BUILTINS
VALID = {
    "boolean": {"true": "true", "0": "false", " 1 ": "true"},
    "decimal": {"-1.23": "-1.23", "+100000.00": "100000", "210": "210", "-0.0": "0", ".5": "0.5", "00": "0", "-.50": "-0.5", "9" * 60: "9" * 60},
    "float": {"0": "0.0E0", "-0": "-0.0E0", "100": "1.0E2", "12.78e-2": "1.278E-1", "+INF": "INF", "-INF": "-INF", "NaN": "NaN", "1e99": "INF"},
    "double": {"1e400": "INF", "1.5": "1.5E0", "123456789": "1.23456789E8", "1e-400": "0.0E0"},
    "duration": {"P1M": "P1M", "P13M": "P1Y1M", "PT36H": "P1DT12H", "-P0D": "PT0S", "PT1.50S": "PT1.5S", "P1Y2M3DT4H5M6S": "P1Y2M3DT4H5M6S", "PT90M": "PT1H30M"},
    "dateTime": {"2001-10-26T21:32:52.1250": "2001-10-26T21:32:52.125", "2001-12-31T24:00:00Z": "2002-01-01T00:00:00Z", "2000-02-28T24:00:00": "2000-02-29T00:00:00", "-0045-01-01T00:00:00+00:00": "-0045-01-01T00:00:00Z", "12345-01-01T00:00:00-05:30": "12345-01-01T00:00:00-05:30"},
    "time": {"24:00:00": "00:00:00", "13:20:00.10+02:00": "13:20:00.1+02:00"},
    "date": {"2024-02-29": "2024-02-29", "2002-10-10-00:00": "2002-10-10Z"},
    "gMonthDay": {"--02-29": "--02-29"},
    "gDay": {"---31Z": "---31Z"},
    "hexBinary": {"0fb7": "0FB7", "": ""},
    "base64Binary": {"AQ ==": "AQ==", "TWFu": "TWFu"},
    "NMTOKENS": {" a  b ": "a b"},
    "precisionDecimal": {"3.00": "3.00", "1E-2": "0.01", "-1.50E8": "-1.50E8", "INF": "INF", "1000000": "1.000000E6"},
}
INVALID = {
    "boolean": ["True", "yes", "", "2"], "decimal": ["1E2", "+", ".", "", "1,0"], "float": ["Infinity", "1.5e", "+NaN", "1f"], "duration": ["P", "PT", "P1S", "1Y", "P1DT", "P-1Y"],
    "dateTime": ["2023-02-29T00:00:00", "2023-13-01T00:00:00", "2023-01-01T24:00:01", "2023-01-01", "02023-01-01T00:00:00"], "time": ["25:00:00", "13:20", "1:20:00", "13:20:00+15:00"], "date": ["2023-02-30", "2002-1-01", "1900-02-29"],
    "gMonthDay": ["--02-30", "--04-31", "10-10"], "gDay": ["---00", "--15"], "gYear": ["999", "02002"], "hexBinary": ["F", "0G"], "base64Binary": ["AQI", "AB==", "A===", "AQJ="], "byte": ["128", "-129", "1.0"], "language": ["toolongtag1"],
    "NCName": ["a:b", "1a", ""], "NMTOKENS": [""], "positiveInteger": ["0"], "yearMonthDuration": ["P1D"], "dayTimeDuration": ["P1M"], "dateTimeStamp": ["2001-01-01T00:00:00"], "error": ["x"],
}


@pytest.mark.parametrize("name", sorted(set(VALID) | set(INVALID)))
def test_vectors(spark, name):
    t = B[name]
    rows = [(a, c) for a, c in VALID.get(name, {}).items()] + [(a, None) for a in INVALID.get(name, [])]
    for r in spark.createDataFrame(rows, "a string, c string").select("a", "c", verdict(F.col("a"), t).alias("v")).collect():
        assert r.v.ok == (r.c is not None), r
        assert r.v.canonical == r.c, r


def test_null_literals_have_no_verdict(spark):
    for t in (B["int"], B["NMTOKENS"], union_of(B["int"], B["date"]), B["date"]):
        assert spark.range(1).select(check(F.lit(None).cast("string"), t)).first()[0] is None


def compare(spark, kind, pairs, constant=False):
    if constant:
        return [spark.createDataFrame([(a,)], "a string").select(V.compare(F.col("a"), b, kind)).first()[0] for a, b in pairs]
    return [r[0] for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(V.compare(F.col("a"), F.col("b"), kind)).collect()]


def test_partial_orders(spark):
    d = [("P1M", "P30D"), ("P1M", "P31D"), ("P1M", "P27D"), ("P1M", "P32D"), ("P1Y", "P12M"), ("PT36H", "P1DT12H"), ("-P1M", "-P40D"), ("P5M", "P150D")]
    want = [None, None, 1, -1, 0, 0, 1, None]
    assert compare(spark, "duration", d) == want and compare(spark, "duration", d, True) == want
    t = [("2002-10-10T12:00:00-05:00", "2002-10-10T17:00:00Z"), ("2002-10-10T12:00:00", "2002-10-10T17:00:00Z"), ("2002-10-09T12:00:00", "2002-10-10T17:00:00Z"), ("2002-10-11T12:00:00", "2002-10-10T17:00:00Z"), ("-0001-01-01T00:00:00", "0001-01-01T00:00:00")]
    assert compare(spark, "dateTime", t) == [0, None, -1, 1, -1]
    assert compare(spark, "double", [("NaN", "NaN"), ("-0", "0"), ("INF", "1e308")]) == [None, 0, 1]
    assert compare(spark, "precisionDecimal", [("3.0", "3.00"), ("1E2", "99.9"), ("-INF", "-1E99"), ("NaN", "1")]) == [0, 1, -1, None]


def test_decimal_keys_order_as_numbers(spark):
    rng = random.Random(7)
    texts = [f"{rng.choice(['', '-', '+'])}{'0' * rng.randint(0, 2)}{rng.randrange(10 ** rng.randint(1, 30))}{rng.choice(['', '.', f'.{rng.randrange(10**8):08d}'])}" for _ in range(120)] + ["0", "-0", "0.0", ".1", "-.1"]
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(600)]
    got = compare(spark, "decimal", pairs)
    want = [(Decimal(a) > Decimal(b)) - (Decimal(a) < Decimal(b)) for a, b in pairs]
    assert got == want
    one = spark.createDataFrame([(x,) for x in texts], "a string").coalesce(1).select("a", V.decimal_key(F.col("a")).alias("k"), V.compare(F.col("a"), "12.5", "decimal").alias("c"), V.compare(F.col("a"), "1" + "0" * 25, "decimal").alias("d")).collect()
    for r in one:
        assert r.k == V.key_of(Decimal(r.a))
        for c, b in ((r.c, Decimal("12.5")), (r.d, Decimal(10) ** 25)):
            assert c == (Decimal(r.a) > b) - (Decimal(r.a) < b)


def test_first_failure_wins_and_facets_overlay(spark):
    t = restrict(restrict(B["string"], "a", maxLength="5", pattern="[a-z]*"), "b", maxLength="3", pattern=[".b.*", "c.*"])
    rows = {"abc": None, "ABC": "cvc-pattern-valid", "abcd": "cvc-maxLength-valid", "xyz": "cvc-pattern-valid", "cc": None}
    got = {r.a: r.v for r in spark.createDataFrame([(x,) for x in rows], "a string").select("a", check(F.col("a"), t).alias("v")).collect()}
    assert got == rows


def test_enumerations_compare_values(spark):
    t = restrict(B["decimal"], "e", enumeration=["1.0", "2"])
    f = restrict(B["double"], "n", enumeration=["NaN", "0"])
    df = spark.createDataFrame([("01",), ("2.00",), ("3",), ("NaN",), ("-0.0",)], "a string").coalesce(1)
    assert [r[0] is None for r in df.limit(3).select(check(F.col("a"), t)).collect()] == [True, True, False]
    assert [r[0] is None for r in df.select(check(F.col("a"), f)).collect()] == [False, False, False, True, True]


def test_lists_and_unions(spark):
    ints = restrict(list_of(B["int"]), "ints", maxLength="3", enumeration=["1 2", "3"])
    u = restrict(union_of(B["int"], B["token"]), "u", pattern="[0-9]+|a b")
    rows = [("01  2", None, "cvc-pattern-valid"), ("1 x", "cvc-pattern-valid", "cvc-pattern-valid"), ("1 2 3 4", "cvc-maxLength-valid", "cvc-pattern-valid"), (" 3 ", None, None), (" a  b ", "cvc-pattern-valid", None)]
    for r in spark.createDataFrame(rows, "a string, l string, u string").select("*", check(F.col("a"), ints).alias("gl"), check(F.col("a"), u).alias("gu")).collect():
        assert (r.gl, r.gu) == (r.l, r.u), r
    k = spark.range(1).select(key(F.lit("1"), B["int"]) == key(F.lit("1.0"), B["decimal"]), key(F.lit("1"), list_of(B["int"])) == key(F.lit("1"), B["int"])).first()
    assert tuple(k) == (True, False)
    assert spark.range(1).select(canonical(F.lit(" 007 "), union_of(B["date"], B["integer"]))).first()[0] == "7"


def test_ungoverned_types_are_undecided(spark):
    with pytest.raises(Undecided):
        check(F.lit("x"), ANY_ATOMIC)
    assert spark.range(1).select(check(F.lit("x"), ERROR)).first()[0] == "cvc-datatype-valid"


def test_fixed_values(spark):
    got = spark.range(1).select(matches_fixed(F.lit("1.50"), "1.5", B["decimal"]), matches_fixed(F.lit("2"), "1.5", B["decimal"]), matches_fixed(F.lit("NaN"), "NaN", B["double"]), matches_fixed(F.lit("x"), "1", B["decimal"])).first()
    assert tuple(got) == (True, False, True, None)


def test_scale_and_zone_facets(spark):
    p = restrict(B["precisionDecimal"], "p", maxScale="2", totalDigits="3")
    z = restrict(B["time"], "z", explicitTimezone="prohibited")
    got = spark.range(1).select(*[check(F.lit(x), p) for x in ("1.23", "1.234", "NaN", "12.30")], *[check(F.lit(x), z) for x in ("10:00:00", "10:00:00Z")]).first()
    assert tuple(got) == (None, "cvc-maxScale-valid", None, "cvc-totalDigits-valid", None, "cvc-explicitTimezone-valid")


def test_qnames_need_bindings(spark):
    t = SimpleType("q", B["QName"])
    b = F.create_map(F.lit("p"), F.lit("urn:p"), F.lit(""), F.lit("urn:d"))
    got = spark.range(1).select(*[check(F.lit(x), t, b).isNull() for x in ("p:a", "a", "z:a", "p:", "1a")]).first()
    assert tuple(got) == (True, True, False, False, False)


PATTERNS = [(r"\d", "٣", True), (r"\d", "a", False), (r"[a-z-[aeiou]]+", "xyz", True), (r"[a-z-[aeiou]]+", "xaz", False), (r"a.c", "a\nc", False), (r"^a$", "^a$", True), (r"\p{Lu}{2}", "ÄB", True), (r"\P{Lu}", "a", True), (r"\p{IsGreek}+", "αβ", True), (r"\i\c*", "a-b.c", True), (r"\w+", "a b", False), (r"[^a]", "b", True), (r"a{2,3}", "aaaa", False), (r"(a|b)*c?", "abab", True), (r"\s", " ", False), (r"[\-x]", "-", True), ("", "", True)]


@pytest.mark.parametrize("p,text,want", PATTERNS)
def test_schema_patterns(spark, p, text, want):
    assert spark.range(1).select(F.lit(text).rlike(translate(p))).first()[0] is want


def test_pattern_flavours_and_errors(spark):
    got = spark.range(1).select(F.lit("xABx").rlike(translate("a b", "fo", "ix")), F.lit("a\nb").rlike(translate("^b$", "fo", "m")), F.lit("a\nb").rlike(translate("a.b", "fo", "s"))).first()
    assert tuple(got) == (True, True, True)
    for p in ("(", r"\1", "a{3,1}", "a{1001}", r"\p{Foo}", r"\p{IsFoo}", "[a", "*a", "a)", "[b-a]", "a**"[:3]):
        with pytest.raises(PatternError) as e:
            translate(p)
        assert e.value.rule == "src-pattern-value"
    with pytest.raises(PatternError) as e:
        translate("a", "fo", "q")
    assert e.value.rule == "err:FORX0001"
    assert re.match(r"\\A", translate("a"))
