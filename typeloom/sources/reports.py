"""Sinks and comparisons of results: violation reports, expectations, ratchet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules that the specifications name, by family, and four of the engine's own.
FAMILIES = {
    "cos": ("cos-", "all-limited applicable-facets assertions-restriction aw-intersect aw-union choice-range content-act-restrict ct-derived-ok ct-extends element-consistent equiv-class equiv-derived-ok-rec group-emptiable nonambig ns-subset particle-extend pattern-restriction seq-range st-derived-ok st-restricts valid-default valid-simple-default ct-extends.1.2"),
    "cvc": ("cvc-", "type elt attribute au complex-type complex-content simple-type datatype-valid facet-valid pattern-valid enumeration-valid length-valid minLength-valid maxLength-valid totalDigits-valid fractionDigits-valid minInclusive-valid minExclusive-valid maxInclusive-valid maxExclusive-valid minScale-valid maxScale-valid explicitTimezone-valid assertions-valid assertion id identity-constraint assess-elt assess-attr attdecl resolve-instance model-group mg mgrp particle p wildcard wildcard-name wildcard-namespace w notation annotation agd accept ta xpath"),
    "sic": ("sic-", "schema schema-all id key e-outcome a-outcome elt-decl attr-decl elt-error-code attr-error-code eltType attrType eltDefault attrDefault inheritedAttrs match-info mg mgrp p w ta agd annotation assertion notation notation-used simple-type"),
    "src": ("src-", "resolve import import-noselfimport include redefine override element attribute attdecl au attribute_group ct simple-type restriction-base-or-simpleType list-itemType-or-simpleType union-memberTypes-or-simpleTypes enumeration-value pattern-value model_group model_group_defn p wildcard identity-constraint notation annotation assertion cip expredef simple-type.1 ta"),
    "err": ("err:", " ".join(f"{k}{n:04d}" for k, ns in {"FOAR": (1, 2), "FOCA": (1, 2, 3, 5, 6), "FOCH": (1, 2, 3, 4), "FODC": (1, 2, 3, 4, 5), "FODT": (1, 2, 3), "FOER": (0,), "FONS": (4, 5), "FORG": (1, 2, 3, 4, 5, 6, 8, 9), "FORX": (1, 2, 3, 4), "FOTY": (12,), "XPDY": (2, 21, 50), "XPST": (1, 3, 5, 8, 10, 17, 51, 80, 81, 83), "XPTY": (4, 6, 7, 18, 19, 20)}.items() for n in ns)),
    "props": ("", " ".join(f"{x}-props-correct" for x in "a ag an as au c ct e mg mgd n p sch st ta w".split())),
    "restriction": ("", "derivation-ok-restriction f-ms-fixed f-mns-fixed fractionDigits-totalDigits length-minLength-maxLength minLength-less-than-equal-to-maxLength minScale-totalDigits " + " ".join(f"{x}-valid-restriction" for x in "length minLength maxLength whiteSpace timezone totalDigits fractionDigits maxInclusive maxExclusive minInclusive minExclusive enumeration maxScale minScale".split())),
    "own": ("", "xml-wf json-wf ber-wf component-invariant"),
}
RULES = tuple((prefix + r, family) for family, (prefix, rs) in FAMILIES.items() for r in rs.split())


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "rule string, family string")


def unknown_rules(violations: DataFrame) -> DataFrame:
    """Rules in a result that the catalogue does not have."""
    return violations.select("rule").distinct().join(F.broadcast(rules(violations.sparkSession)), "rule", "left_anti")


def rendered(doc: Column, line: Column, column: Column, rule: Column, message: Column) -> Column:
    """``document:line:column: [rule] message``; ``?`` where there is no place."""
    place = F.when(line.isNull(), F.concat(doc, F.lit(":?"))).otherwise(F.concat_ws(":", doc, line.cast("string"), column.cast("string")))
    return F.concat(place, F.lit(": ["), rule, F.lit("] "), F.coalesce(message, F.lit("")))


def suite_cases(spark: SparkSession, documents: dict[str, str], version: str = "1.1") -> DataFrame:
    """``case, kind, document, expected`` of test-suite catalogues given as text:
    groups of schema and instance tests.  Tests for other versions are withheld,
    with a null expectation."""
    from .xml_reader import Element, read

    rows = []

    def expected(e: Element) -> str | None:
        if e.get("version") and version not in e.get("version").split():
            return None
        for x in e.elements("expected"):
            if not x.get("version") or version in x.get("version").split():
                return x.get("validity")
        return None

    for name, text in documents.items():
        for group in read(text).elements("testGroup"):
            for kind in ("schemaTest", "instanceTest"):
                for t in group.elements(kind):
                    doc = next((a.value for d in t.elements("schemaDocument", "instanceDocument") for a in d.attrs if a.local == "href"), None)
                    rows.append((f"{name}/{group.get('name')}/{t.get('name')}", kind, doc, expected(t)))
    return spark.createDataFrame(rows, "case string, kind string, document string, expected string")


def write_expectations(df: DataFrame, path: str) -> None:
    """Sorted lines ``<case> <status>`` from ``case, status``."""
    df.select(F.concat_ws(" ", "case", "status").alias("value")).orderBy("value").write.mode("overwrite").text(path)


def read_expectations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("trim(value) <> ''").select(F.substring_index("value", " ", 1).alias("case"), F.substring_index("value", " ", -1).alias("status"))


def ratchet(expected: DataFrame, actual: DataFrame, withheld: DataFrame | None = None) -> DataFrame:
    """``case, delta``: improved, regressed, new, removed, vanished or same.  A
    case that is expected but absent was removed if it was withheld, else it
    vanished."""
    e, a = expected.select("case", F.col("status").alias("e")), actual.select("case", F.col("status").alias("a"))
    both = e.join(a, "case", "full")
    if withheld is not None:
        both = both.join(withheld.select("case", F.lit(True).alias("w")), "case", "left")
    else:
        both = both.withColumn("w", F.lit(None).cast("boolean"))
    delta = F.when(F.col("e").isNull(), "new").when(F.col("a").isNull(), F.when(F.col("w"), "removed").otherwise("vanished")).when(F.col("e") == F.col("a"), "same").when(F.col("a") == "pass", "improved").otherwise("regressed")
    return both.select("case", delta.alias("delta"))
