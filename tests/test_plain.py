"""Documents shredded many at a time have the parser's nodes."""

import random

import pyarrow as pa
import pytest

from typeloom import queries as engine
from typeloom.sources import xml_nodes, xml_plain
from typeloom.sources.structs import flat_rows
from typeloom.sources.xml_nodes import shred

ODD = [
    '<a><b x="1" y="2">t<c/>u</b>\n <b/></a>', "<a/>", "<a >x</a>", '<a b="1" />', "<a></b>", "<a>", "<a/><b/>", '<a b="1" b="2"/>', '<a xmlns="u"/>', "<a>&amp;</a>", "<a>]]></a>", "<a>x>y</a>", '<a b="x>y"/>', "", None, '<a b="<"/>', '<a\n b="1"/>',
    "<a></a >", "<>", "</a>", "</>", "<a><b></a></b>", "<1/>", "<a b='1'/>", '<a b="1"c="2"/>', '<a b="1\t"/>', "<a>é</a>", "<a> <b> </b>\t\n</a>\n", " <a/>", "<!-- x --><a/>", '<?xml version="1.0"?><a/>', '<a b=""/>', "<a/>x<b/>", "<a/ >", '<a b="1"//>',
    "<a>" + "<b>" * 70 + "</b>" * 70 + "</a>", "<a", "<a><", '<a b="1"  c="2"/>', "</a><a>", "<a></a></a>", "<a>\x0b</a>", "<a>\r\n<b/></a>", '<a><b/>\n\n  <c d="e">\n</c></a>', "<a b>", '<a =""/>', "<a:b/>", '<a x:y="1"/>', ">", "<a>></a>",
]


def documents(n):
    r = random.Random(7)

    def element(depth):
        name, attrs = r.choice(["a", "b", "c-1"]), "".join(f' {k}="{r.choice(["", "1", "x y", ">", "/"])}"' for k in r.sample(["p", "q", "r"], r.randint(0, 2)))
        if r.random() < 0.2:
            return f"<{name}{attrs}/>"
        inner = "".join(r.choice(["", " ", "\n", 't"']) + (element(depth + 1) if depth < 4 else "") for _ in range(r.randint(0, 3)))
        return f"<{name}{attrs}>{inner}{r.choice(['', 'z', ' '])}</{name}>"

    for _ in range(n):
        s = element(0)
        i = r.randrange(len(s))
        yield s if r.random() < 0.6 else s[:i] + r.choice(["", "<", ">", "/", '"', " ", "&", "=", "a", ":", "]"]) + s[i + r.randint(0, 1) :]


@pytest.mark.parametrize("at_a_time", [1, 9, 10_000])
def test_plain_documents_have_the_parsers_nodes(at_a_time):
    docs = ODD + list(documents(500))
    every = pa.schema([*xml_nodes.SCHEMA, *xml_nodes.MORE])
    want = xml_nodes.batch([r for i, d in enumerate(docs) for some in xml_nodes.rows(str(i), d, True) for r in some], every).to_pylist()
    got, plain = [], 0
    for i in range(0, len(docs), at_a_time):
        ids, texts = pa.array([str(k) for k in range(i, min(len(docs), i + at_a_time))]), pa.array(docs[i : i + at_a_time], pa.string())
        plain += xml_plain.shred_plain(ids, texts, xml_nodes.WHOLE, every)[0].sum()
        got += [r for b in xml_nodes._some(ids, texts, every) for r in b.to_pylist()]
    assert sorted(got, key=lambda r: int(r["doc_id"])) == want
    assert 150 < plain < len(docs)


def test_only_what_is_read_is_made(spark, sf):
    df = spark.createDataFrame([("1", ODD[0]), ("2", "<a>"), ("3", None), ("4", "<a>&amp;<b/></a>")], "id string, xml string")
    every = shred(df, "id", "xml")
    some = shred(df, "id", "xml", ["name", "doc_id", "rule"])
    assert some.columns == ["name", "doc_id", "rule"]
    assert sorted(map(str, some.collect())) == sorted(map(str, every.select(*some.columns).collect()))
    one = shred(df, "id", "xml", names=["b"])
    assert sorted(map(str, one.collect())) == sorted(map(str, every.where("name = 'b' or rule is not null").collect()))


def test_the_query_makes_names_alone(spark, sf):
    plan = engine.QUERIES["xml_nodes"](spark, sf)._jdf.queryExecution().analyzed()
    made = plan.toString().split("MapInArrow", 1)[1].split("\n", 1)[0]
    assert "name#" in made and "attrs#" not in made and "path#" not in made


def test_rows_of_nodes_with_fields_need_no_shuffle(spark):
    docs = [("1", '<r><l a="1"><q>2</q><z/></l><l><q>9</q><q>10</q></l><l a=""/></r>'), ("2", '<l a="&lt;"><q>x<q>y</q></q></l>'), ("3", "<l>")]
    df = spark.createDataFrame(docs, "id string, xml string")
    want = flat_rows(shred(df, "id", "xml"), "l", ["@a", "q", "none"])
    got = flat_rows(shred(df, "id", "xml", ["doc_id", "node_id", "name", "attrs", "fields"]), "l", ["@a", "q", "none"])
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 4
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
