"""Schema compilation, content models, assessment, keys, conditional types."""

import pytest
from pyspark.sql import functions as F

from typeloom.functions.types import BUILTINS
from typeloom.operators.assess import Assessment
from typeloom.operators.cta import Declined, StaticError, compile_test
from typeloom.operators.paths import check_constraint, key_table
from typeloom.plans.content import automaton
from typeloom.plans.model import SchemaError, XPath
from typeloom.plans.namespaces import ANY, NamespaceConstraint, Occurs, Wildcard, complement, difference, intersect, parse, subset, union
from typeloom.plans.xsd import chain, compile_schema, compile_text, directory, memory
from typeloom.sources.xml_nodes import shred
from typeloom.sources.xml_reader import XmlError, decode, read

XS = 'xmlns:xs="http://www.w3.org/2001/XMLSchema"'
ORDER = f"""<xs:schema {XS} elementFormDefault="qualified">
<xs:simpleType name="money"><xs:restriction base="xs:decimal"><xs:minInclusive value="0"/><xs:fractionDigits value="2"/></xs:restriction></xs:simpleType>
<xs:complexType name="lineT"><xs:sequence><xs:element name="part" type="xs:int"/><xs:element name="price" type="money"/></xs:sequence><xs:attribute name="n" type="xs:positiveInteger" use="required"/><xs:attribute name="unit" type="xs:string" fixed="EUR"/></xs:complexType>
<xs:complexType name="giftT"><xs:complexContent><xs:extension base="lineT"><xs:sequence><xs:element name="note" type="xs:string"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType>
<xs:element name="order"><xs:complexType><xs:sequence><xs:element name="id" type="xs:ID"/><xs:element name="see" type="xs:IDREF" minOccurs="0"/><xs:element name="line" type="lineT" maxOccurs="unbounded"/><xs:element name="status" type="xs:string" nillable="true" minOccurs="0"/></xs:sequence></xs:complexType>
<xs:key name="k"><xs:selector xpath="line"/><xs:field xpath="@n"/></xs:key></xs:element>
</xs:schema>"""


def line(n="1", part="5", price="1.50", more="", attrs=""):
    return f'<line n="{n}" {attrs}><part>{part}</part><price>{price}</price>{more}</line>'


def order(body, id_="a", see=""):
    return f'<order xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"><id>{id_}</id>{see}{body}</order>'


CASES = {
    "ok": (order(line() + line("2")), []),
    "gift": (order(line(more="<note>x</note>", attrs='xsi:type="giftT"')), []),
    "bad-type": (order(line(attrs='xsi:type="money"')), [("cvc-elt", "4")]),
    "unknown-type": (order(line(attrs='xsi:type="none"')), []),
    "int": (order(line(part="x")), [("cvc-type", "3.1.3")]),
    "facet": (order(line(price="-1")), [("cvc-type", "3.1.3")]),
    # the key's field has no value then, so the key is incomplete as well
    "attr": (order(line(n="0")), [("cvc-attribute", "3"), ("cvc-identity-constraint", "4.2.1")]),
    "fixed": (order(line(attrs='unit="USD"')), [("cvc-au", "")]),
    "unmatched": (order(line(attrs='zz="1"')), [("cvc-complex-type", "2")]),
    "missing": (order("<line><part>1</part><price>2</price></line>"), [("cvc-complex-type", "3"), ("cvc-identity-constraint", "4.2.1")]),
    "reject": (order(line() + "<zz><part>x</part></zz>"), [("cvc-complex-content", "reject")]),
    "short": (order(""), [("cvc-complex-content", "short")]),
    "text": (order("hello" + line()), [("cvc-complex-type", "1.3")]),
    "nil": (order(line() + '<status xsi:nil="true"/>'), []),
    "nil-content": (order(line() + '<status xsi:nil="true">x</status>'), [("cvc-elt", "3.2.3.1")]),
    "nil-bad": (order(line(attrs='xsi:nil="true"')), [("cvc-elt", "3.1")]),
    "root": ("<other/>", [("cvc-assess-elt", "")]),
    "wf": ("<order><id></order>", [("xml-wf", "")]),
    "idref": (order(line(), see="<see>a</see>"), []),
    "dangling": (order(line(), see="<see>b</see>"), [("cvc-id", "1")]),
}


def test_assessment_of_documents(spark):
    a = Assessment(compile_text(ORDER))
    docs = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "doc_id string, xml string")
    got = {}
    for r in a.assess(shred(docs, "doc_id", "xml")).collect():
        got.setdefault(r.doc_id, []).append((r.rule, r.clause))
    assert {k: sorted(got.get(k, [])) for k in CASES} == {k: sorted(v[1]) for k, v in CASES.items()}


def test_keys_by_path(spark):
    s = compile_text(ORDER)
    docs = spark.createDataFrame([("a", order(line("1") + line("01") + line("2"))), ("b", order(line("1") + "<line/>"))], "doc_id string, xml string")
    nodes = shred(docs, "doc_id", "xml").where("rule is null").cache()
    hosts = nodes.where("name = 'order'").select("doc_id", F.col("node_id").alias("host_id"), F.col("last_id").alias("host_last"), F.col("depth").alias("host_depth"))
    c = s.constraints[("", "k")]
    got = sorted((r.doc_id, r.clause) for r in check_constraint(nodes, hosts, c, [BUILTINS["integer"]]).collect())
    assert got == [("a", "4.2.2"), ("b", "4.2.1")]
    assert key_table(nodes, hosts, c, [BUILTINS["string"]]).where("doc_id = 'a'").select("k0").distinct().count() == 3


MODELS = [
    ("<xs:sequence><xs:element name='a'/><xs:element name='b' minOccurs='0'/><xs:element name='c' maxOccurs='2'/></xs:sequence>", {"ac": None, "abcc": None, "a": "short", "abccc": 4, "ba": 0}),
    ("<xs:choice minOccurs='2' maxOccurs='3'><xs:element name='a'/><xs:element name='b'/></xs:choice>", {"ab": None, "aba": None, "a": "short", "abab": 3}),
    ("<xs:all><xs:element name='a'/><xs:element name='b' minOccurs='0'/><xs:element name='c' maxOccurs='2'/></xs:all>", {"cac": None, "bca": None, "a": "short", "aa": 1}),
    ("<xs:sequence><xs:element name='a'/><xs:any namespace='##any' processContents='skip' minOccurs='0'/></xs:sequence>", {"a": None, "az": None, "azz": 2}),
    ("<xs:sequence><xs:element name='a' minOccurs='0' maxOccurs='300'/></xs:sequence>", {"": None, "a" * 300: None, "a" * 301: 300}),
]


@pytest.mark.parametrize("model,cases", MODELS)
def test_content_models(spark, model, cases):
    s = compile_text(f"<xs:schema {XS}><xs:complexType name='t'>{model}</xs:complexType></xs:schema>")
    a = automaton(s.types[("", "t")], s)
    df = spark.createDataFrame([(k, list(k)) for k in cases], "k string, children array<string>")
    for r in df.select("k", a.verdict(F.col("children")).alias("v")).collect():
        want = cases[r.k]
        assert (r.v.ok, r.v.reject_index, r.v.too_short) == (want is None, want if isinstance(want, int) else None, want == "short"), r.k
        ok, at, _ = a.match([("", c) for c in r.k])
        assert (ok, at) == (r.v.ok, r.v.reject_index)


BAD = [
    ("<xs:element name='a'/><xs:element name='a'/>", "sch-props-correct"),
    ("<xs:element name='a' type='xs:none'/>", "src-resolve"),
    ("<xs:element name='a' default='1' fixed='1'/>", "src-element"),
    ("<xs:simpleType name='s'><xs:restriction base='xs:int'><xs:length value='1'/></xs:restriction></xs:simpleType>", "cos-applicable-facets"),
    ("<xs:simpleType name='s'><xs:restriction base='xs:byte'><xs:maxInclusive value='500'/></xs:restriction></xs:simpleType>", "maxInclusive-valid-restriction"),
    ("<xs:simpleType name='s'><xs:restriction base='xs:string'><xs:minLength value='5'/><xs:maxLength value='2'/></xs:restriction></xs:simpleType>", "minLength-less-than-equal-to-maxLength"),
    ("<xs:simpleType name='s'><xs:restriction base='xs:string'><xs:pattern value='('/></xs:restriction></xs:simpleType>", "src-pattern-value"),
    ("<xs:simpleType name='s'><xs:restriction base='s'/></xs:simpleType>", "st-props-correct"),
    ("<xs:simpleType name='s'><xs:list itemType='xs:NMTOKENS'/></xs:simpleType>", "cos-st-restricts"),
    ("<xs:complexType name='c'><xs:sequence><xs:element name='a' minOccurs='0'/><xs:element name='a'/></xs:sequence></xs:complexType>", "cos-nonambig"),
    ("<xs:complexType name='c'><xs:sequence><xs:element name='a' type='xs:int'/><xs:element name='b'/><xs:element name='a' type='xs:date'/></xs:sequence></xs:complexType>", "cos-element-consistent"),
    ("<xs:complexType name='c'><xs:sequence><xs:element name='a' minOccurs='3' maxOccurs='2'/></xs:sequence></xs:complexType>", "p-props-correct"),
    ("<xs:group name='g'><xs:sequence><xs:group ref='g'/></xs:sequence></xs:group>", "mg-props-correct"),
    ("<xs:complexType name='c'><xs:sequence><xs:all/></xs:sequence></xs:complexType>", "cos-all-limited"),
    ("<xs:element name='a' substitutionGroup='b' type='xs:string'/><xs:element name='b' type='xs:int'/>", "e-props-correct"),
    ("<xs:complexType name='b'><xs:sequence><xs:element name='x'/></xs:sequence></xs:complexType><xs:complexType name='c'><xs:complexContent><xs:restriction base='b'><xs:sequence><xs:element name='x' maxOccurs='2'/></xs:sequence></xs:restriction></xs:complexContent></xs:complexType>", "derivation-ok-restriction"),
    ("<xs:complexType name='c'><xs:attribute name='p'/><xs:attribute name='p'/></xs:complexType>", "ct-props-correct"),
    ("<xs:notation name='n'/>", "src-notation"),
    ("<xs:element name='a'><xs:complexType><xs:sequence><xs:element name='i' maxOccurs='9'/></xs:sequence></xs:complexType><xs:keyref name='r' refer='none'><xs:selector xpath='i'/><xs:field xpath='.'/></xs:keyref></xs:element>", "src-resolve"),
]


@pytest.mark.parametrize("body,rule", BAD)
def test_schemas_that_break_a_rule(spark, body, rule):
    with pytest.raises(SchemaError) as e:
        compile_text(f"<xs:schema {XS}>{body}</xs:schema>")
    assert e.value.rule == rule


def test_value_constraints_are_judged_like_data(spark):
    with pytest.raises(SchemaError) as e:
        compile_text(f"<xs:schema {XS}><xs:element name='a' type='xs:int' default='x'/></xs:schema>")
    assert e.value.rule == "e-props-correct"


def test_composition(tmp_path):
    lib = f"<xs:schema {XS}><xs:simpleType name='code'><xs:restriction base='xs:string'><xs:maxLength value='3'/></xs:restriction></xs:simpleType><xs:element name='e' type='code'/></xs:schema>"
    ns = f"<xs:schema {XS} targetNamespace='urn:t' xmlns='urn:t'><xs:include schemaLocation='lib.xsd'/><xs:element name='f' type='code'/></xs:schema>"
    s = compile_text(ns, **{"lib.xsd": lib})
    assert set(s.elements) == {("urn:t", "e"), ("urn:t", "f")}  # the library took on the namespace
    other = f"<xs:schema {XS} xmlns:t='urn:t'><xs:import namespace='urn:t' schemaLocation='ns.xsd'/><xs:element name='g' type='t:code'/></xs:schema>"
    s = compile_text(other, **{"lib.xsd": lib, "ns.xsd": ns})
    assert ("urn:t", "code") in s.types and ("", "g") in s.elements
    with pytest.raises(SchemaError) as e:
        compile_text(f"<xs:schema {XS} xmlns:t='urn:t'><xs:element name='g' type='t:code'/></xs:schema>")
    assert e.value.rule == "src-resolve"
    over = f"<xs:schema {XS}><xs:override schemaLocation='lib.xsd'><xs:simpleType name='code'><xs:restriction base='xs:int'/></xs:simpleType></xs:override></xs:schema>"
    assert compile_text(over, **{"lib.xsd": lib}).types[("", "code")].derives_from("int")
    redo = f"<xs:schema {XS}><xs:redefine schemaLocation='lib.xsd'><xs:simpleType name='code'><xs:restriction base='code'><xs:minLength value='1'/></xs:restriction></xs:simpleType></xs:redefine></xs:schema>"
    t = compile_text(redo, **{"lib.xsd": lib}).types[("", "code")]
    assert t.facet("maxLength") == "3" and t.facet("minLength") == "1"
    (tmp_path / "a.xsd").write_text(lib)
    s = compile_schema("a.xsd", chain(memory({}), directory(str(tmp_path))))
    assert s.report == [("a.xsd", "document", "used")]
    with pytest.raises(SchemaError):
        compile_schema("../a.xsd", directory(str(tmp_path / "x")))


def test_catalog_and_substitution(spark):
    s = compile_text(f"<xs:schema {XS}><xs:element name='h' type='xs:decimal'/><xs:element name='m' substitutionGroup='h' type='xs:int'/><xs:element name='n' substitutionGroup='m'/><xs:complexType name='c'><xs:attribute name='p' type='xs:int' default='4'/></xs:complexType></xs:schema>")
    assert [e.name[1] for e in s.members(("", "h"))] == ["h", "m", "n"]
    c = s.catalog(spark)
    assert c["substitutions"].count() == 6 and c["elements"].count() == 3
    assert c["attributes"].first().default == "4"


def test_namespace_algebra():
    a, b = NamespaceConstraint("enumeration", frozenset("ab")), NamespaceConstraint("not", frozenset("bc"))
    for x in (a, b, ANY):
        for y in (a, b, ANY):
            for n in "abcd":
                assert union(x, y).allows(n) == (x.allows(n) or y.allows(n))
                assert intersect(x, y).allows(n) == (x.allows(n) and y.allows(n))
                assert difference(x, y).allows(n) == (x.allows(n) and not y.allows(n))
            assert subset(intersect(x, y), x) and subset(x, union(x, y))
    assert complement(NamespaceConstraint("enumeration")) == ANY
    assert not parse("##other", None, "t").allows("t") and parse("##targetNamespace ##local", None, "t").allows("")
    assert not Wildcard(ANY, disallowed=frozenset([("", "x")])).admits(("", "x"))
    assert Occurs(1, 2).times(Occurs(0, None)) == Occurs(0, None) and Occurs(2, 3).within(Occurs(1, None))


def test_wildcard_columns(spark):
    w = Wildcard(NamespaceConstraint("not", frozenset(["t"])), disallowed=frozenset([("u", "x")]), defined=True)
    rows = [(ns, n) for ns in ("t", "u", "") for n in ("x", "y")]
    df = spark.createDataFrame(rows, "ns string, n string")
    known = frozenset([("", "y")])
    got = {(r.ns, r.n) for r in df.where(w.column(F.col("ns"), F.col("n"), known)).collect()}
    assert got == {r for r in rows if w.admits(r, known)}


CTA = [("@kind = 'book'", True), ("@n <= 5", True), ("@n = 3", True), ("not(@none)", True), ("@none or @n", True), ("(@kind = 'x' or @n > 2) and @p:q", True), ("@n = 3e0 (: note :)", True), ("@kind > 3", False), ("not(@kind > 3)", False), ("xs:integer(@n) = 3", True), ("@n cast as xs:boolean", False), ("@*", True), ("@p:*", True), ("@*:q = 'z'", True), ("'it''s' = @kind", False), ("@d < xs:date('2024-01-01')", True)]


@pytest.mark.parametrize("test,want", CTA)
def test_conditions(spark, test, want):
    x = XPath(test, {"xs": "http://www.w3.org/2001/XMLSchema", "p": "urn:p"})
    df = spark.createDataFrame([([("kind", "book"), ("n", "3"), ("{urn:p}q", "z"), ("d", "2023-05-05")],)], "attrs array<struct<name: string, value: string>>")
    assert df.select(compile_test(x, F.col("attrs"))).first()[0] is want


def test_conditions_outside_the_subset(spark):
    for t in ("@a idiv 2", "-@n = 1", "@a = 1 1", "f(@a, 1)", "xs:float(@a) = 2e0", "(: open"):
        with pytest.raises(Declined):
            compile_test(XPath(t, {"xs": "http://www.w3.org/2001/XMLSchema"}), F.col("attrs"))
    with pytest.raises(StaticError):
        compile_test(XPath("@z:a", {}), F.col("attrs"))


def test_reading_and_encodings():
    assert decode("﻿<a/>".encode("utf-16")) .endswith("<a/>")
    for bad in (b"<a", b"<a b='1' b='2'/>", b"<p:a/>", b"<a xmlns:p='u' xmlns:q='u' p:x='1' q:x='2'/>", b"<!DOCTYPE a [<!ENTITY e 'x'>]><a>&e;</a>", b"<?xml version='1.0' encoding='latin-1'?><a/>", b"\xff<a/>"):
        with pytest.raises(XmlError):
            read(bad)
    e = read('<r xmlns="urn:d" xmlns:p="urn:p" id="1" p:lang="en">a<![CDATA[b]]>&amp;<p:b><c/></p:b>\r\n</r>')
    assert e.ns == "urn:d" and [(a.ns, a.local) for a in e.attrs] == [("", "id"), ("urn:p", "lang")] and e.text().startswith("ab&")
    assert e.elements()[0].elements()[0].ns == "urn:d" and (e.line, e.column) == (1, 1)


def test_custom_mappings(spark):
    from typeloom.functions import values as V
    from typeloom.functions.facets import verdict

    mine = V.override({"boolean": V.Mapping(canonical=lambda c: F.upper(c))}, {"boolean": V.Mapping(ok=lambda c: c.isin("ja", "nein"))})
    V.CUSTOM.update(mine)
    try:
        v = spark.range(1).select(verdict(F.lit("ja"), BUILTINS["boolean"]), verdict(F.lit("true"), BUILTINS["boolean"])).first()
    finally:
        V.CUSTOM.clear()
    assert (v[0].ok, v[0].canonical, v[1].ok) == (True, "JA", False)


def test_native_columns_and_encoding(spark):
    from typeloom.sources.structs import encode, native

    r = spark.range(1).select(native(F.lit(" 12 "), BUILTINS["int"]), native(F.lit("x"), BUILTINS["int"]), native(F.lit("-INF"), BUILTINS["double"]), native(F.lit("1"), BUILTINS["boolean"]), native(F.lit("a  b"), BUILTINS["NMTOKENS"])).first()
    assert tuple(r) == (12, None, float("-inf"), True, ["a", "b"])
    xml = encode(spark.createDataFrame([("x", 3)], "_id string, n int"), "row").first().xml
    e = read(xml)
    assert (e.local, e.get("id"), e.elements()[0].text()) == ("row", "x", "3")


def test_suite_catalogue(spark):
    from typeloom.sources.reports import suite_cases

    text = '<testSet xmlns:x="http://www.w3.org/1999/xlink"><testGroup name="g"><schemaTest name="s"><schemaDocument x:href="a.xsd"/><expected validity="valid"/></schemaTest><instanceTest name="i" version="1.0"><instanceDocument x:href="a.xml"/><expected validity="invalid"/></instanceTest></testGroup></testSet>'
    assert sorted(map(tuple, suite_cases(spark, {"set": text}).collect())) == [("set/g/i", "instanceTest", "a.xml", None), ("set/g/s", "schemaTest", "a.xsd", "valid")]


def test_command_line(spark, tmp_path, capsys):
    from typeloom.__main__ import main

    (tmp_path / "s.xsd").write_text(ORDER)
    (tmp_path / "a.xml").write_text(CASES["int"][0])
    assert main(["parse", str(tmp_path / "s.xsd")]) == 0
    assert "elements 0 order" in capsys.readouterr().out
    assert main(["validate", str(tmp_path / "s.xsd"), str(tmp_path / "*.xml")]) == 1
    assert "[cvc-type] 3.1.3 cvc-pattern-valid" in capsys.readouterr().out
    assert main(["gen", str(tmp_path / "s.xsd"), "order"]) == 0
    (tmp_path / "bad.xsd").write_text("<a/>")
    assert main(["parse", str(tmp_path / "bad.xsd")]) == 1


def test_node_tables_move_keys_outwards(spark):
    from typeloom.operators.paths import node_tables

    hosts = spark.createDataFrame([("d", 0, 9, 0), ("d", 1, 4, 1), ("d", 5, 9, 1), ("d", 6, 7, 2)], "doc_id string, host_id long, host_last long, host_depth int")
    entries = spark.createDataFrame([("d", 1, "a", 2), ("d", 5, "a", 8), ("d", 5, "b", 9), ("d", 6, "b", 7), ("d", 6, "c", 7), ("d", 0, "z", 0)], "doc_id string, host_id long, key string, target_id long")
    got = {(r.host_id, r.key, r.target_id) for r in node_tables(entries, hosts).collect()}
    # a: two inner hosts differ, so it does not reach the root; b: the own entry of 5 beats 6's
    assert got == {(1, "a", 2), (5, "a", 8), (5, "b", 9), (6, "b", 7), (6, "c", 7), (5, "c", 7), (0, "b", 9), (0, "c", 7), (0, "z", 0)}


def test_building_without_a_document(spark):
    from typeloom.plans.model import ComplexType, ElementDecl, Group, Particle, SchemaBuilder

    t = ComplexType(("", "t"), None, variety="element-only", particle=Particle(Occurs(), Group("sequence", [Particle(Occurs(0, 2), ElementDecl(("", "a"), BUILTINS["int"]))])))
    s = SchemaBuilder().type(("", "t"), t).element(ElementDecl(("", "r"), t)).build()
    docs = spark.createDataFrame([("x", "<r><a>1</a><a>2</a></r>"), ("y", "<r><a>1</a><a>2</a><a>3</a></r>")], "doc_id string, xml string")
    assert [(r.doc_id, r.rule) for r in Assessment(s).assess(shred(docs, "doc_id", "xml")).collect()] == [("y", "cvc-complex-content")]
    with pytest.raises(SchemaError):
        SchemaBuilder().notation(("", "n"))


def test_streams(spark, tmp_path):
    from typeloom.functions.types import restrict
    from typeloom.streaming.validate import rule_counts, unique

    rows = [(i, f"2024-01-01 0{i % 3}:00:00", str(i)) for i in range(9)]
    spark.createDataFrame(rows, "k int, t string, v string").select("k", F.to_timestamp("t").alias("t"), "v").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, t timestamp, v string").parquet(str(tmp_path / "in"))
    counts = rule_counts(stream, {"v": restrict(BUILTINS["int"], "v", maxInclusive="4")}, "t")
    q = counts.writeStream.outputMode("complete").format("memory").queryName("rules").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("rules").agg(F.sum("n")).first()[0] == 4
    twice = spark.readStream.schema("k int, t timestamp, v string").parquet(str(tmp_path / "in")).withColumn("k", F.col("k") % 3)
    q = unique(twice, ["k"], "t", "5 hours").writeStream.outputMode("append").format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 3
