"""Assessment of nodes that know their children: the same, and nodes stay."""

from typeloom.operators.assess import Assessment
from typeloom.plans.xsd import compile_text
from typeloom.sources.xml_nodes import shred

XS = 'xmlns:xs="http://www.w3.org/2001/XMLSchema"'
TREE = f"""<xs:schema {XS}><xs:element name="t"><xs:complexType><xs:sequence><xs:element name="n" type="xs:int" minOccurs="0" maxOccurs="2"/><xs:element ref="t" minOccurs="0" maxOccurs="2"/><xs:element name="e" type="xs:int"/></xs:sequence>
<xs:attribute name="k" type="xs:int" use="required"/></xs:complexType></xs:element></xs:schema>"""
BAD = '<t><n>x</n><e>y</e></t>'
DOCS = {
    "good": '<t k="1"><n>1</n><e>2</e></t>', "values": BAD, "short": '<t k="1"><n>1</n></t>', "broken": "<t>", "none": None, "root": "<u/>", "reference": '<t k="&#49;"><n>&#120;</n><q/></t>',
    "cut": f'<t k="a"><n>x</n><n>1</n><n>2</n>{BAD}<n>y</n><e>z</e></t>', "below": f'<t>\n<t k="1"><n>x</n><q>{BAD}</q><e>w</e></t>\n {BAD}<e>v</e></t>',
    "in the cut": f'<t k="1"><q/><t><q/>{BAD}</t><t/></t>', "twice": f'<t k="1"><t><q/><n>x</n></t><t><n>x</n><q/>{BAD}</t><e>y</e><e/></t>', "text": '<t k="1" z="">a<e q="1">5</e></t>',
}


def test_the_same_violations_as_of_moved_nodes(spark):
    df = spark.createDataFrame(list(DOCS.items()), "id string, xml string")
    want = Assessment(compile_text(TREE)).assess(shred(df, "id", "xml"))
    got = Assessment(compile_text(TREE)).assess(shred(df, "id", "xml", Assessment.COLUMNS))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert want.count() > 25
    # nodes as such do not move: what does has no content
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "decl#" not in "".join(x for x in plan.split("\n") if "Join" in x) and plan.count("Join") == 2
