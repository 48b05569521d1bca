"""Node tables made while documents are parsed."""

import pytest

from typeloom.plans.xsd import compile_text
from typeloom.sources import ber_nodes, json_nodes, xml_nodes
from typeloom.sources.json_nodes import Names

XS = 'xmlns:xs="http://www.w3.org/2001/XMLSchema"'
DOCS = [
    '<r xmlns="urn:d" xmlns:p="urn:p" id="1" p:lang="en">a<![CDATA[b]]>&amp;<p:b><c xmlns=""/></p:b>\n <d xmlns:p="urn:q"><p:e/></d></r>',
    "<a>" + "<b x='1'>t<c/>u</b>" * 700 + "</a>", "<a>" + "<b>" * 50 + "é" + "</b>" * 50 + "</a>", "<a><b></a>", "<a>" + "<b/>" * 500 + "<c></a>", "<p:a/>", "", "<a/><b/>", "<a>\ud800</a>",
]


def flat(doc):
    return [r for some in xml_nodes.rows("d", doc) for r in some]


@pytest.mark.parametrize("doc", DOCS)
def test_parts_give_the_same_nodes_and_nothing_of_a_broken_document(doc, monkeypatch):
    whole = flat(doc)
    monkeypatch.setattr(xml_nodes, "WHOLE", 10)
    monkeypatch.setattr(xml_nodes, "PART", 7)
    monkeypatch.setattr(xml_nodes, "BATCH", 3)
    assert flat(doc) == whole
    assert len(whole) == 1 if whole[0][1] else all(r[1] is None for r in whole)


def test_ancestors_and_last_nodes_are_consistent():
    by = {r[3]: r for r in flat(DOCS[1])}
    assert sorted(by) == list(range(len(by)))
    for n, r in by.items():
        assert r[19] == ([*by[r[4]][19], r[4]] if r[4] is not None else [])
        assert all(u in by[k][19] for u in [n] for k in range(n + 1, r[5] + 1))


def test_json_nulls_depth_and_odd_documents():
    s = compile_text(f"<xs:schema {XS}><xs:element name='r'><xs:complexType><xs:sequence><xs:any minOccurs='0' processContents='skip'/></xs:sequence><xs:attribute name='k'/></xs:complexType></xs:element></xs:schema>")
    names = Names(s, ("", "r"))
    assert json_nodes.rows(names, "d", None) == []
    for bad in ("", "{", "[1]", "7", "{" * 100_000, "null"):
        (row,) = json_nodes.rows(names, "d", bad)
        assert row[1] == "json-wf"
    made = json_nodes.rows(names, "d", '{"k": 1.50, "x": [[1, null], {"k": {"y": true}}], "k2": "long "}')
    assert [r[8] for r in made] == ["r", "x", "x", "x", "x", "k", "y", "k2"]
    assert made[0][9] == [{"name": "k", "value": "1.50"}] and made[3][9][0]["value"] == "true"


def test_ber_headers():
    assert ber_nodes.header(b"\x9f\x81\x01\x00", 0) == (2, 129, False, 4, 0)
    assert ber_nodes.header(b"\x30\x82\x01\x00" + b"0" * 256, 0) == (0, 16, True, 4, 256)
    for bad in (b"", b"\x30", b"\x04\x80", b"\x04\x05abc", b"\x04\x82\x01"):
        with pytest.raises(ber_nodes.BerError):
            ber_nodes.header(bad, 0)
    assert ber_nodes.rows({}, "d", None) == []
