"""Identity constraints and IDs as part of assessing documents."""

from typeloom.operators.assess import Assessment
from typeloom.plans.xsd import compile_text
from typeloom.sources.xml_nodes import shred

XS = 'xmlns:xs="http://www.w3.org/2001/XMLSchema"'
XSI = 'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'
SHOP = f"""<xs:schema {XS}>
<xs:element name="shop"><xs:complexType><xs:sequence><xs:element ref="box" minOccurs="0" maxOccurs="9"/><xs:element name="use" minOccurs="0" maxOccurs="9"><xs:complexType><xs:attribute name="k" type="xs:integer"/></xs:complexType></xs:element></xs:sequence></xs:complexType>
<xs:keyref name="uses" refer="items"><xs:selector xpath="use"/><xs:field xpath="@k"/></xs:keyref></xs:element>
<xs:element name="box"><xs:complexType><xs:sequence><xs:element name="part" minOccurs="0" maxOccurs="9"><xs:complexType><xs:sequence><xs:element ref="box"/></xs:sequence></xs:complexType></xs:element><xs:element name="item" minOccurs="0" maxOccurs="9"><xs:complexType><xs:sequence><xs:element name="name" type="xs:string" minOccurs="0" maxOccurs="2"/><xs:element name="code" type="xs:double" nillable="true" minOccurs="0"/></xs:sequence><xs:attribute name="k" type="xs:integer"/><xs:attribute name="z" type="xs:integer" default="7"/></xs:complexType></xs:element></xs:sequence></xs:complexType>
<xs:key name="items"><xs:selector xpath="item"/><xs:field xpath="@k"/></xs:key>
<xs:unique name="names"><xs:selector xpath=".//item"/><xs:field xpath="name"/><xs:field xpath="@z"/></xs:unique></xs:element>
<xs:element name="codes"><xs:complexType><xs:sequence><xs:element name="code" type="xs:double" nillable="true" maxOccurs="9"/></xs:sequence></xs:complexType>
<xs:key name="codes"><xs:selector xpath="code"/><xs:field xpath="."/></xs:key></xs:element>
<xs:element name="plain"><xs:complexType><xs:sequence><xs:element name="code" type="xs:double" maxOccurs="9"/></xs:sequence></xs:complexType>
<xs:unique name="plain"><xs:selector xpath="code"/><xs:field xpath="."/></xs:unique></xs:element></xs:schema>"""

ID = "cvc-identity-constraint"
ITEM = '<item k="{}"/>'
BOX = lambda *k: f"<box>{''.join(map(ITEM.format, k))}</box>"
CASES = {
    "good": (f'<shop>{BOX(1, 2)}{BOX(3)}<use k="03"/></shop>', []),
    "duplicate key": (f"<shop>{BOX(1, '01', 1)}</shop>", ["4.2.2", "4.2.2"]),
    "incomplete": ("<shop><box><item/></box></shop>", ["4.2.1"]),
    "two fields": ('<box><item k="1"><name>a</name></item><item k="2"><name>a</name></item><item k="3"/></box>', ["4.1"]),
    "a default counts": ('<box><item k="1" z="7"><name>a</name></item><item k="2"><name>a</name></item></box>', ["4.1"]),
    "several nodes": ('<box><item k="1"><name>a</name><name>b</name></item></box>', ["3"]),
    "dangling": (f'<shop>{BOX(1)}<use k="2"/><use/></shop>', ["4.3"]),
    "no key at all": ('<shop><use k="2"/></shop>', ["4.3"]),
    "keys of two boxes": (f'<shop>{BOX(1)}{BOX(1)}<use k="1"/></shop>', ["4.3"]),
    # the two inner boxes lose 1 in the outer box, so the third alone brings it to the shop
    "between": (f'<shop><box><part>{BOX(1)}</part><part>{BOX(1)}</part></box>{BOX(1)}<use k="1"/></shop>', []),
    "declined": (f'<shop><box><item k="1"><name>a</name><name>b</name></item><item k="x"/></box><use k="2"/></shop>', ["3", "4.2.1", "4.3"]),
    "nillable": ("<codes><code>1</code></codes>", ["4.2.3"]),
    "nilled": (f'<codes {XSI}><code xsi:nil="true"/></codes>', []),
    "NaN is itself": ("<plain><code>NaN</code><code>NaN</code><code>0</code><code>-0</code></plain>", ["4.1", "4.1"]),
}


def test_every_clause_of_identity_constraints(spark):
    docs = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "doc_id string, xml string")
    got = {k: [] for k in CASES}
    for r in Assessment(compile_text(SHOP)).assess(shred(docs, "doc_id", "xml")).collect():
        if r.rule == ID:
            assert r.node_id is not None and r.line == 1
            got[r.doc_id].append(r.clause)
    assert {k: sorted(v) for k, v in got.items()} == {k: v[1] for k, v in CASES.items()}


IDS = f"""<xs:schema {XS}>
<xs:simpleType name="uid"><xs:union memberTypes="xs:ID xs:string"/></xs:simpleType><xs:simpleType name="usi"><xs:union memberTypes="xs:string xs:ID"/></xs:simpleType>
<xs:simpleType name="uref"><xs:union memberTypes="xs:IDREF xs:string"/></xs:simpleType><xs:simpleType name="lur"><xs:list itemType="uref"/></xs:simpleType>
<xs:element name="r"><xs:complexType><xs:sequence><xs:element name="i" maxOccurs="9"><xs:complexType><xs:attribute name="uid" type="uid"/><xs:attribute name="usi" type="usi"/><xs:attribute name="uref" type="uref"/><xs:attribute name="lur" type="lur"/><xs:attribute name="ref" type="xs:IDREF"/></xs:complexType></xs:element>
<xs:element name="d" minOccurs="0"><xs:complexType><xs:attribute name="x" type="xs:ID" default="given"/></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element></xs:schema>"""
ID_CASES = {
    "twice by a union": ('<r><i uid="a"/><i uid="a"/></r>', ["2"]),
    "reference to a union's": ('<r><i uid="a"/><i ref="a"/></r>', []),
    "by the string member": ('<r><i uid="1 a"/><i uid="1 a"/></r>', []),
    "string comes first": ('<r><i usi="a"/><i usi="a"/></r>', []),
    "dangling by unions": ('<r><i uref="b" lur="c 1"/></r>', ["1", "1"]),
    "defaulted": ('<r><i ref="given"/><d/></r>', []),
    "not defaulted": ('<r><i ref="given"/><d x="own"/></r>', ["1"]),
}


def test_ids_by_union_members_and_defaults(spark):
    docs = spark.createDataFrame([(k, v[0]) for k, v in ID_CASES.items()], "doc_id string, xml string")
    got = {k: [] for k in ID_CASES}
    for r in Assessment(compile_text(IDS)).assess(shred(docs, "doc_id", "xml")).collect():
        got[r.doc_id].append(r.clause)
    assert {k: sorted(v) for k, v in got.items()} == {k: v[1] for k, v in ID_CASES.items()}
