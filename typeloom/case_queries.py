"""Registered queries over cases: small inputs with one result each, and the
results that the specifications of schemas, datatypes and patterns ask for.

Each query runs its operator over its cases; its SQL is the table of results, so
a comparison of both is a test of the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values as V
from .functions.facets import check, matches_fixed, verdict
from .functions.patterns import PatternError, category, chars, complement, difference, intersection, translate, union as either
from .functions.types import APPLICABLE, BUILTINS, SimpleType, list_of, restrict, union_of
from .operators.assess import Assessment
from .operators.cta import Declined as CtaDeclined
from .operators.cta import StaticError, compile_test
from .operators.paths import Declined as PathDeclined
from .operators.paths import compile_path
from .plans.content import Declined, ambiguous, automaton, included
from .plans.model import Attribute, ComplexType, ElementDecl, Group, Particle, SchemaBuilder, SchemaError, XPath
from .plans.namespaces import ANY, NamespaceConstraint, Occurs, Wildcard, complement as outside, difference as less, intersect, parse, subset, union
from .plans.xsd import chain, compile_schema, compile_text, memory
from .sources import reports
from .sources.ber_nodes import shred_ber
from .sources.json_nodes import shred_json
from .sources.structs import encode, native, schema_to_struct
from .sources.xml_nodes import shred
from .sources.xml_reader import XmlError, decode, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
B = BUILTINS
XS = 'xmlns:xs="http://www.w3.org/2001/XMLSchema"'
XSI = 'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'
XMAP = {"xs": "http://www.w3.org/2001/XMLSchema"}


def _sql(ddl: str, rows: list[tuple]) -> str:
    kinds = {"string": "VARCHAR", "long": "BIGINT", "boolean": "BOOLEAN"}
    columns = [c.split() for c in ddl.split(", ")]
    value = lambda v, k: "NULL" if v is None else str(v).lower() if k == "boolean" else str(v) if k == "long" else "'" + str(v).replace("'", "''") + "'"
    table = ", ".join("(" + ", ".join(f"CAST({value(v, k)} AS {kinds[k]})" for v, (_, k) in zip(r, columns)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {table}) AS t({', '.join(c for c, _ in columns)})"


def cases(ddl: str, want: list[tuple]) -> Callable[[Query], Query]:
    """Registers a query with the rows that it has to give."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__], SQL[f.__name__] = f, _sql(ddl, want)
        return f

    return add


def schema(body: str, attrs: str = "") -> str:
    return f"<xs:schema {XS} {attrs}>{body}</xs:schema>"


def broken(body: str, attrs: str = "", **more: str) -> str:
    """The rule that a schema breaks, or ok."""
    try:
        compile_text(schema(body, attrs), **more)
    except SchemaError as e:
        return e.rule
    return "ok"


def by_case(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


# schema constraints -----------------------------------------------------------

SIMPLE = lambda inner, name="s": f"<xs:simpleType name='{name}'>{inner}</xs:simpleType>"
STEP = lambda base, facets, name="s": SIMPLE(f"<xs:restriction base='{base}'>{facets}</xs:restriction>", name)
MODEL = lambda inner, name="c": f"<xs:complexType name='{name}'>{inner}</xs:complexType>"
DERIVED = lambda way, base, inner, name="c": MODEL(f"<xs:complexContent><xs:{way} base='{base}'>{inner}</xs:{way}></xs:complexContent>", name)
SEQ = lambda inner: f"<xs:sequence>{inner}</xs:sequence>"

NAMES = [
    ("two elements", "<xs:element name='a'/><xs:element name='a'/>", "sch-props-correct"),
    ("two types", STEP("xs:int", "") + MODEL("", "s"), "sch-props-correct"),
    ("element and type", "<xs:element name='a'/>" + STEP("xs:int", "", "a"), "ok"),
    ("no such type", "<xs:element name='a' type='xs:none'/>", "src-resolve"),
    ("no such base", STEP("xs:none", ""), "src-resolve"),
    ("no such group", MODEL("<xs:group ref='g'/>"), "src-resolve"),
    ("no such attribute group", MODEL("<xs:attributeGroup ref='g'/>"), "src-resolve"),
    ("no such attribute", MODEL("<xs:attribute ref='g'/>"), "src-resolve"),
    ("no such element", MODEL(SEQ("<xs:element ref='g'/>")), "src-resolve"),
    ("no such key", "<xs:element name='a'><xs:keyref name='r' refer='none'><xs:selector xpath='i'/><xs:field xpath='.'/></xs:keyref></xs:element>", "src-resolve"),
    ("a type used before it is given", "<xs:element name='a' type='s'/>" + STEP("xs:int", ""), "ok"),
    ("notation", "<xs:notation name='n'/>", "src-notation"),
    ("public notation", "<xs:notation name='n' public='p'/>", "ok"),
]


@cases("name string, rule string", [(n, r) for n, _, r in NAMES])
def schema_names(spark, sf):
    return by_case(spark, [(n, broken(b)) for n, b, _ in NAMES], "name string, rule string")


CYCLES = [
    ("simple base", STEP("s", ""), "st-props-correct"),
    ("simple base of two", STEP("t", "", "s") + STEP("s", "", "t"), "st-props-correct"),
    ("union of itself", SIMPLE("<xs:union memberTypes='s xs:int'/>"), "cos-st-restricts"),
    ("complex base", DERIVED("extension", "c", ""), "ct-props-correct"),
    ("group", "<xs:group name='g'><xs:sequence><xs:group ref='g'/></xs:sequence></xs:group>", "mg-props-correct"),
    ("substitution", "<xs:element name='a' substitutionGroup='b'/><xs:element name='b' substitutionGroup='a'/>", "e-props-correct"),
    ("an element in itself", "<xs:element name='a'><xs:complexType><xs:sequence><xs:element ref='a' minOccurs='0'/></xs:sequence></xs:complexType></xs:element>", "ok"),
    ("a type in itself", MODEL(SEQ("<xs:element name='x' type='c' minOccurs='0'/>")), "ok"),
]


@cases("name string, rule string", [(n, r) for n, _, r in CYCLES])
def schema_cycles(spark, sf):
    return by_case(spark, [(n, broken(b)) for n, b, _ in CYCLES], "name string, rule string")


FACETS = [
    ("length of a number", STEP("xs:int", "<xs:length value='1'/>"), "cos-applicable-facets"),
    ("digits of a string", STEP("xs:string", "<xs:totalDigits value='1'/>"), "cos-applicable-facets"),
    ("bounds of a boolean", STEP("xs:boolean", "<xs:minInclusive value='0'/>"), "cos-applicable-facets"),
    ("zone of a time", STEP("xs:time", "<xs:explicitTimezone value='required'/>"), "ok"),
    ("maximum beyond the base's", STEP("xs:byte", "<xs:maxInclusive value='500'/>"), "maxInclusive-valid-restriction"),
    ("minimum below the base's", STEP("xs:positiveInteger", "<xs:minInclusive value='0'/>"), "minInclusive-valid-restriction"),
    ("narrower", STEP("xs:byte", "<xs:maxInclusive value='5'/><xs:minInclusive value='-5'/>"), "ok"),
    ("shortest over longest", STEP("xs:string", "<xs:minLength value='5'/><xs:maxLength value='2'/>"), "minLength-less-than-equal-to-maxLength"),
    ("longer than the base", STEP("xs:string", "<xs:maxLength value='2'/>", "t") + STEP("t", "<xs:maxLength value='3'/>"), "maxLength-valid-restriction"),
    ("shorter than the base", STEP("xs:string", "<xs:minLength value='2'/>", "t") + STEP("t", "<xs:minLength value='1'/>"), "minLength-valid-restriction"),
    ("another length", STEP("xs:string", "<xs:length value='2'/>", "t") + STEP("t", "<xs:length value='3'/>"), "length-valid-restriction"),
    ("more digits", STEP("xs:decimal", "<xs:totalDigits value='2'/>", "t") + STEP("t", "<xs:totalDigits value='3'/>"), "totalDigits-valid-restriction"),
    ("more fraction digits", STEP("xs:decimal", "<xs:fractionDigits value='2'/>", "t") + STEP("t", "<xs:fractionDigits value='3'/>"), "fractionDigits-valid-restriction"),
    ("fraction over total", STEP("xs:decimal", "<xs:totalDigits value='2'/><xs:fractionDigits value='3'/>"), "fractionDigits-totalDigits"),
    ("white space widens", STEP("xs:token", "<xs:whiteSpace value='preserve'/>"), "whiteSpace-valid-restriction"),
    ("white space narrows", STEP("xs:string", "<xs:whiteSpace value='collapse'/>"), "ok"),
    ("zone changes", STEP("xs:dateTimeStamp", "<xs:explicitTimezone value='prohibited'/>"), "timezone-valid-restriction"),
    ("a fixed facet", STEP("xs:string", "<xs:maxLength value='4' fixed='true'/>", "t") + STEP("t", "<xs:maxLength value='3'/>"), "maxLength-valid-restriction"),
    ("inclusive and exclusive", STEP("xs:int", "<xs:minInclusive value='1'/><xs:minExclusive value='1'/>"), "st-props-correct"),
    ("no pattern", STEP("xs:string", "<xs:pattern value='('/>"), "src-pattern-value"),
    ("patterns of one step", STEP("xs:string", "<xs:pattern value='a'/><xs:pattern value='b'/>"), "ok"),
    ("list of lists", SIMPLE("<xs:list itemType='xs:NMTOKENS'/>"), "cos-st-restricts"),
    ("list of a union of lists", SIMPLE("<xs:union memberTypes='xs:NMTOKENS xs:int'/>", "u") + SIMPLE("<xs:list itemType='u'/>"), "cos-st-restricts"),
    ("union", SIMPLE("<xs:union memberTypes='xs:int xs:date'/>"), "ok"),
    ("a value outside the base", STEP("xs:int", "<xs:enumeration value='x'/>"), "enumeration-valid-restriction"),
    ("dates the wrong way round", STEP("xs:date", "<xs:minInclusive value='2024-01-02'/><xs:maxInclusive value='2024-01-01'/>"), "minInclusive-valid-restriction"),
    ("numbers the wrong way round", STEP("xs:int", "<xs:minInclusive value='2'/><xs:maxInclusive value='1'/>"), "minInclusive-valid-restriction"),
    ("a later date than the base's", STEP("xs:date", "<xs:maxInclusive value='2024-01-01'/>", "t") + STEP("t", "<xs:maxInclusive value='2024-01-02'/>"), "maxInclusive-valid-restriction"),
    ("a longer duration than the base's", STEP("xs:dayTimeDuration", "<xs:maxInclusive value='P1D'/>", "t") + STEP("t", "<xs:maxInclusive value='PT25H'/>"), "maxInclusive-valid-restriction"),
    ("an earlier date", STEP("xs:date", "<xs:maxInclusive value='2024-01-01'/>", "t") + STEP("t", "<xs:maxInclusive value='2023-12-31'/>"), "ok"),
]


@cases("name string, rule string", [(n, r) for n, _, r in FACETS])
def schema_facets(spark, sf):
    return by_case(spark, [(n, broken(b)) for n, b, _ in FACETS], "name string, rule string")


X, Y = "<xs:element name='x'/>", "<xs:element name='y'/>"
MODELS = [
    ("two particles for a name", MODEL(SEQ("<xs:element name='a' minOccurs='0'/><xs:element name='a'/>")), "cos-nonambig"),
    ("two wildcards", MODEL("<xs:choice><xs:any/><xs:any namespace='##other'/></xs:choice>"), "cos-nonambig"),
    ("an element beats a wildcard", MODEL("<xs:choice><xs:element name='a'/><xs:any/></xs:choice>"), "ok"),
    ("a member and its head", "<xs:element name='h'/><xs:element name='m' substitutionGroup='h'/>" + MODEL("<xs:choice><xs:element ref='h'/><xs:element ref='m'/></xs:choice>"), "cos-nonambig"),
    ("a counted repeat", MODEL(SEQ("<xs:element name='a' maxOccurs='2'/><xs:element name='b'/>")), "ok"),
    ("two types for a name", MODEL(SEQ("<xs:element name='a' type='xs:int'/><xs:element name='b'/><xs:element name='a' type='xs:date'/>")), "cos-element-consistent"),
    ("least over most", MODEL(SEQ("<xs:element name='a' minOccurs='3' maxOccurs='2'/>")), "p-props-correct"),
    ("all in a sequence", MODEL("<xs:sequence><xs:all/></xs:sequence>"), "cos-all-limited"),
    ("all by a group", "<xs:group name='g'><xs:all><xs:element name='x'/></xs:all></xs:group>" + MODEL("<xs:group ref='g'/>"), "ok"),
    ("all with a repeat", MODEL("<xs:all><xs:element name='x' maxOccurs='3'/></xs:all>"), "ok"),
]


@cases("name string, rule string", [(n, r) for n, _, r in MODELS])
def schema_models(spark, sf):
    return by_case(spark, [(n, broken(b)) for n, b, _ in MODELS], "name string, rule string")


BASE = MODEL(SEQ("<xs:element name='x' type='xs:decimal'/><xs:element name='y' minOccurs='0'/>") + "<xs:attribute name='p' type='xs:decimal' use='required'/><xs:attribute name='q' fixed='1'/>", "b")
P = "<xs:attribute name='p' type='xs:int' use='required'/>"
XD = "<xs:element name='x' type='xs:decimal'/>"
DERIVATIONS = [
    ("subset", BASE + DERIVED("restriction", "b", SEQ(XD) + P), "ok"),
    ("more than the base", BASE + DERIVED("restriction", "b", SEQ(XD + "<xs:element name='y' maxOccurs='2'/>")), "derivation-ok-restriction"),
    ("another element", BASE + DERIVED("restriction", "b", SEQ(XD + "<xs:element name='z'/>")), "derivation-ok-restriction"),
    ("a type from elsewhere", BASE + DERIVED("restriction", "b", SEQ("<xs:element name='x' type='xs:date'/>")), "derivation-ok-restriction"),
    ("a derived type", BASE + DERIVED("restriction", "b", SEQ("<xs:element name='x' type='xs:int'/>")), "ok"),
    ("nillable where the base is not", BASE + DERIVED("restriction", "b", SEQ("<xs:element name='x' type='xs:decimal' nillable='true'/>")), "derivation-ok-restriction"),
    ("a new attribute", BASE + DERIVED("restriction", "b", SEQ(XD) + "<xs:attribute name='z'/>"), "derivation-ok-restriction"),
    ("an attribute no longer required", BASE + DERIVED("restriction", "b", SEQ(XD) + "<xs:attribute name='p' type='xs:decimal'/>"), "derivation-ok-restriction"),
    ("a required attribute prohibited", BASE + DERIVED("restriction", "b", SEQ(XD) + "<xs:attribute name='p' use='prohibited'/>"), "derivation-ok-restriction"),
    ("another fixed value", BASE + DERIVED("restriction", "b", SEQ(XD) + "<xs:attribute name='q' fixed='2'/>"), "derivation-ok-restriction"),
    ("a wildcard the base has not", BASE + DERIVED("restriction", "b", SEQ(XD) + "<xs:anyAttribute/>"), "derivation-ok-restriction"),
    ("extension", BASE + DERIVED("extension", "b", SEQ("<xs:element name='z'/>") + "<xs:attribute name='z'/>"), "ok"),
    ("an attribute twice", BASE + DERIVED("extension", "b", "<xs:attribute name='p'/>"), "ct-props-correct"),
    ("an attribute twice in one type", MODEL("<xs:attribute name='p'/><xs:attribute name='p'/>"), "ct-props-correct"),
    ("mixed extends element-only", BASE + MODEL("<xs:complexContent mixed='true'><xs:extension base='b'>" + SEQ("<xs:element name='z'/>") + "</xs:extension></xs:complexContent>"), "cos-ct-extends"),
    ("a final base", MODEL("", "b").replace("name='b'", "name='b' final='extension'") + DERIVED("extension", "b", ""), "cos-ct-extends"),
    ("a final simple base", STEP("xs:int", "", "t").replace("name='t'", "name='t' final='restriction'") + STEP("t", ""), "st-props-correct"),
    ("simple content extended", MODEL("<xs:simpleContent><xs:extension base='xs:int'><xs:attribute name='u'/></xs:extension></xs:simpleContent>"), "ok"),
    ("simple content widened", MODEL("<xs:simpleContent><xs:extension base='xs:byte'/></xs:simpleContent>", "b") + MODEL("<xs:simpleContent><xs:restriction base='b'><xs:maxInclusive value='300'/></xs:restriction></xs:simpleContent>"), "maxInclusive-valid-restriction"),
    ("extension of content by text", BASE + MODEL("<xs:simpleContent><xs:extension base='b'/></xs:simpleContent>"), "src-ct"),
]


@cases("name string, rule string", [(n, r) for n, _, r in DERIVATIONS])
def schema_derivations(spark, sf):
    return by_case(spark, [(n, broken(b)) for n, b, _ in DERIVATIONS], "name string, rule string")


VALUES = [
    ("default and fixed", "<xs:element name='a' default='1' fixed='1'/>", "src-element"),
    ("default outside the type", "<xs:element name='a' type='xs:int' default='x'/>", "e-props-correct"),
    ("fixed outside the type", "<xs:element name='a' type='xs:date' fixed='2024-02-30'/>", "e-props-correct"),
    ("a default that is collapsed first", "<xs:element name='a' type='xs:int' default=' 7 '/>", "ok"),
    ("a default on elements only", "<xs:element name='a' default='1'><xs:complexType><xs:sequence><xs:element name='x'/></xs:sequence></xs:complexType></xs:element>", "e-props-correct"),
    ("an attribute's default", MODEL("<xs:attribute name='p' type='xs:boolean' default='maybe'/>"), "a-props-correct"),
    ("a required default", MODEL("<xs:attribute name='p' use='required' default='1'/>"), "src-attribute"),
    ("a substitute of another type", "<xs:element name='a' substitutionGroup='b' type='xs:string'/><xs:element name='b' type='xs:int'/>", "e-props-correct"),
    ("a substitute of a derived type", "<xs:element name='a' substitutionGroup='b' type='xs:byte'/><xs:element name='b' type='xs:int'/>", "ok"),
    ("a final head", "<xs:element name='a' substitutionGroup='b' type='xs:byte'/><xs:element name='b' type='xs:int' final='restriction'/>", "e-props-correct"),
    ("an alternative of another type", "<xs:element name='a' type='xs:int'><xs:alternative test='@k' type='xs:string'/></xs:element>", "e-props-correct"),
    ("an alternative that is an error", "<xs:element name='a' type='xs:int'><xs:alternative test='@k' type='xs:error'/></xs:element>", "ok"),
    ("a keyref with fewer fields", "<xs:element name='a'><xs:key name='k'><xs:selector xpath='i'/><xs:field xpath='@a'/><xs:field xpath='@b'/></xs:key><xs:keyref name='r' refer='k'><xs:selector xpath='i'/><xs:field xpath='@a'/></xs:keyref></xs:element>", "c-props-correct"),
    ("two constraints of a name", "<xs:element name='a'><xs:key name='k'><xs:selector xpath='i'/><xs:field xpath='@a'/></xs:key><xs:unique name='k'><xs:selector xpath='i'/><xs:field xpath='@a'/></xs:unique></xs:element>", "sch-props-correct"),
]


@cases("name string, rule string", [(n, r) for n, _, r in VALUES])
def schema_value_constraints(spark, sf):
    return by_case(spark, [(n, broken(b)) for n, b, _ in VALUES], "name string, rule string")


GRAMMAR = [
    ("annotations everywhere", "<xs:annotation><xs:documentation>x<b/></xs:documentation></xs:annotation><xs:element name='a'><xs:annotation/><xs:complexType><xs:annotation/><xs:sequence><xs:annotation/></xs:sequence></xs:complexType></xs:element><xs:annotation/>", None),
    ("two annotations in one", "<xs:element name='a'><xs:annotation/><xs:annotation/></xs:element>", 1),
    ("an include after an element", "<xs:element name='a'/><xs:include schemaLocation='lib.xsd'/>", 1),
    ("attributes before the model", MODEL("<xs:attribute name='p'/><xs:sequence/>"), 1),
    ("two models", MODEL("<xs:sequence/><xs:choice/>"), 1),
    ("a model beside simple content", MODEL("<xs:simpleContent><xs:extension base='xs:int'/></xs:simpleContent><xs:sequence/>"), 1),
    ("an attribute after the wildcard", MODEL("<xs:anyAttribute/><xs:attribute name='p'/>"), 1),
    ("a type of two kinds", "<xs:element name='a'><xs:simpleType><xs:list itemType='xs:int'/></xs:simpleType><xs:complexType/></xs:element>", 1),
    ("a key before its type", "<xs:element name='a'><xs:key name='k'><xs:selector xpath='b'/><xs:field xpath='.'/></xs:key><xs:complexType/></xs:element>", 1),
    ("a field before the selector", "<xs:element name='a'><xs:key name='k'><xs:field xpath='.'/><xs:selector xpath='b'/></xs:key></xs:element>", 1),
    ("a key without a field", "<xs:element name='a'><xs:key name='k'><xs:selector xpath='b'/></xs:key></xs:element>", 1),
    ("a simple type of nothing", "<xs:simpleType name='s'/>", 1),
    ("a facet in a list", SIMPLE("<xs:list itemType='xs:int'><xs:maxLength value='1'/></xs:list>"), 1),
    ("an element of no schema", "<xs:elemental name='a'/>", 1),
    ("an element of another namespace", "<o:element xmlns:o='urn:o' name='a'/>", 1),
    ("an element in an attribute", MODEL("<xs:attribute name='p'><xs:element name='a'/></xs:attribute>"), 1),
]


def _fault(body: str) -> int:
    """1 for a fault of the grammar, which has no rule."""
    try:
        compile_text(schema(body), **FILES)
    except SchemaError as e:
        return 1 if e.rule == "" else 2
    return 0


@cases("name string, fault long", [(n, w or 0) for n, _, w in GRAMMAR])
def schema_grammar(spark, sf):
    return by_case(spark, [(n, _fault(b)) for n, b, _ in GRAMMAR], "name string, fault long")


# composition ------------------------------------------------------------------

LIB = schema("<xs:simpleType name='code'><xs:restriction base='xs:string'><xs:maxLength value='3'/></xs:restriction></xs:simpleType><xs:element name='e' type='code'/>")
NS = schema("<xs:include schemaLocation='lib.xsd'/><xs:element name='f' type='code'/>", "targetNamespace='urn:t' xmlns='urn:t'")
DEEP = schema("<xs:include schemaLocation='../lib.xsd'/>")
PARTS = schema("<xs:group name='g'><xs:sequence><xs:element name='a'/><xs:element name='b' minOccurs='0'/></xs:sequence></xs:group><xs:attributeGroup name='ag'><xs:attribute name='p' type='xs:decimal' use='required'/><xs:attribute name='q'/></xs:attributeGroup><xs:element name='r'><xs:complexType><xs:group ref='g'/><xs:attributeGroup ref='ag'/></xs:complexType></xs:element>")
REDO = lambda inner: schema(f"<xs:redefine schemaLocation='parts.xsd'>{inner}</xs:redefine>")
FILES = {"parts.xsd": PARTS, "lib.xsd": LIB, "ns.xsd": NS, "sub/deep.xsd": DEEP, "loop.xsd": schema("<xs:include schemaLocation='loop2.xsd'/><xs:element name='l1'/>"), "loop2.xsd": schema("<xs:include schemaLocation='loop.xsd'/><xs:element name='l2'/>"), "other.xsd": schema("<xs:element name='o'/>", "targetNamespace='urn:o'"), "bad.xsd": "<xs:schema"}
SETS = [
    ("include", schema("<xs:include schemaLocation='lib.xsd'/>"), "e"),
    ("include takes on the namespace", schema("<xs:include schemaLocation='ns.xsd'/>", "targetNamespace='urn:t'"), "urn:t e, urn:t f"),
    ("include of another namespace", schema("<xs:include schemaLocation='other.xsd'/>", "targetNamespace='urn:t'"), "src-include"),
    ("include twice", schema("<xs:include schemaLocation='lib.xsd'/><xs:include schemaLocation='lib.xsd'/>"), "e"),
    ("include in a circle", schema("<xs:include schemaLocation='loop.xsd'/>"), "l1, l2"),
    ("a location relative to its document", schema("<xs:include schemaLocation='sub/deep.xsd'/>"), "e"),
    ("import", schema("<xs:import namespace='urn:o' schemaLocation='other.xsd'/><xs:element name='g'/>"), "g, urn:o o"),
    ("import of one's own", schema("<xs:import namespace='urn:t'/>", "targetNamespace='urn:t'"), "src-import"),
    ("import of the wrong namespace", schema("<xs:import namespace='urn:x' schemaLocation='other.xsd'/>"), "src-import"),
    ("import without a document", schema("<xs:import namespace='urn:x' schemaLocation='none.xsd'/><xs:element name='g'/>"), "g"),
    ("a name that no import licenses", schema("<xs:element name='g' type='t:code'/>", "xmlns:t='urn:t'"), "src-resolve"),
    ("override", schema("<xs:override schemaLocation='lib.xsd'><xs:simpleType name='code'><xs:restriction base='xs:int'/></xs:simpleType></xs:override>"), "e"),
    ("redefine", schema("<xs:redefine schemaLocation='lib.xsd'><xs:simpleType name='code'><xs:restriction base='code'><xs:minLength value='1'/></xs:restriction></xs:simpleType></xs:redefine>"), "e"),
    ("redefine of another base", schema("<xs:redefine schemaLocation='lib.xsd'><xs:simpleType name='code'><xs:restriction base='xs:int'/></xs:simpleType></xs:redefine>"), "src-redefine"),
    ("a group that keeps itself", REDO("<xs:group name='g'><xs:sequence><xs:group ref='g'/><xs:element name='c'/></xs:sequence></xs:group>"), "r"),
    ("a group that names itself twice", REDO("<xs:group name='g'><xs:sequence><xs:group ref='g'/><xs:group ref='g'/></xs:sequence></xs:group>"), "src-redefine"),
    ("a narrower group", REDO("<xs:group name='g'><xs:sequence><xs:element name='a'/></xs:sequence></xs:group>"), "r"),
    ("a wider group", REDO("<xs:group name='g'><xs:sequence><xs:element name='a'/><xs:element name='c'/></xs:sequence></xs:group>"), "src-redefine"),
    ("attributes that keep themselves", REDO("<xs:attributeGroup name='ag'><xs:attributeGroup ref='ag'/><xs:attribute name='z'/></xs:attributeGroup>"), "r"),
    ("narrower attributes", REDO("<xs:attributeGroup name='ag'><xs:attribute name='p' type='xs:int' use='required'/></xs:attributeGroup>"), "r"),
    ("an attribute of another type", REDO("<xs:attributeGroup name='ag'><xs:attribute name='p' type='xs:date' use='required'/></xs:attributeGroup>"), "src-redefine"),
    ("one attribute more", REDO("<xs:attributeGroup name='ag'><xs:attribute name='p' type='xs:decimal' use='required'/><xs:attribute name='z'/></xs:attributeGroup>"), "src-redefine"),
    ("redefine of what is not there", schema("<xs:redefine schemaLocation='lib.xsd'><xs:simpleType name='none'><xs:restriction base='none'/></xs:simpleType></xs:redefine>"), "src-redefine"),
]


def _elements(text: str) -> str:
    try:
        s = compile_text(text, **FILES)
    except SchemaError as e:
        return e.rule
    return ", ".join(sorted(" ".join(filter(None, n)) for n in s.elements))


@cases("name string, result string", [(n, r) for n, _, r in SETS])
def schema_composition(spark, sf):
    return by_case(spark, [(n, _elements(t)) for n, t, _ in SETS], "name string, result string")


@cases("name string, base string, facets string", [("override", "integer", "fractionDigits=0 maxInclusive=2147483647 minInclusive=-2147483648"), ("redefine", "string", "maxLength=3 minLength=1")])
def schema_replacements(spark, sf):
    rows = []
    for n, text, _ in SETS:
        if n in ("override", "redefine"):
            t = compile_text(text, **FILES).types[("", "code")]
            base = "integer" if t.derives_from("integer") else t.primitive()
            rows.append((n, base, " ".join(sorted(f"{f.kind}={f.values[0]}" for f, _ in t.effective() if f.kind not in ("whiteSpace", "pattern")))))
    return by_case(spark, rows, "name string, base string, facets string")


@cases("document string, directive string, outcome string", [("schema.xsd", "document", "used"), ("lib.xsd", "document", "used"), ("other.xsd", "document", "used"), ("none.xsd", "document", "not found"), ("schema.xsd", "import urn:y", "no location")])
def assembly_report(spark, sf):
    text = schema("<xs:include schemaLocation='lib.xsd'/><xs:import namespace='urn:o' schemaLocation='other.xsd'/><xs:import namespace='urn:x' schemaLocation='none.xsd'/><xs:import namespace='urn:y'/>")
    return by_case(spark, compile_text(text, **FILES).report, "document string, directive string, outcome string")


@cases("name string, result string", [("first", "a"), ("second", "b"), ("neither", "missing")])
def resolver_chain(spark, sf):
    find = chain(memory({"x.xsd": schema("<xs:element name='a'/>")}), memory({"x.xsd": schema("<xs:element name='no'/>"), "y.xsd": schema("<xs:element name='b'/>")}))

    def of(at: str) -> str:
        try:
            return next(iter(compile_schema(at, find).elements))[1]
        except SchemaError:
            return "missing"

    return by_case(spark, [("first", of("x.xsd")), ("second", of("y.xsd")), ("neither", of("z.xsd"))], "name string, result string")


# components -------------------------------------------------------------------

SHOP = schema(
    SIMPLE("<xs:restriction base='xs:decimal'><xs:minInclusive value='0'/><xs:fractionDigits value='2'/></xs:restriction>", "money")
    + SIMPLE("<xs:list itemType='xs:int'/>", "ints")
    + SIMPLE("<xs:union memberTypes='xs:int money'/>", "num")
    + "<xs:attributeGroup name='ag'><xs:attribute name='unit' type='xs:NCName' default='EUR'/><xs:anyAttribute namespace='##other' processContents='lax'/></xs:attributeGroup>"
    + "<xs:group name='g'><xs:choice><xs:element name='c1'/><xs:element name='c2'/></xs:choice></xs:group>"
    + MODEL(SEQ("<xs:element name='price' type='money'/><xs:group ref='g' minOccurs='0'/>") + "<xs:attribute name='n' type='xs:positiveInteger' use='required'/><xs:attributeGroup ref='ag'/>", "line")
    + DERIVED("extension", "line", SEQ("<xs:element name='note' type='xs:string'/>") + "<xs:attribute name='to'/>", "gift")
    + MODEL("<xs:simpleContent><xs:extension base='money'><xs:attribute name='cur' fixed='EUR'/></xs:extension></xs:simpleContent>", "amount")
    + MODEL("<xs:sequence/>", "nothing")
    + "<xs:complexType name='prose' mixed='true'><xs:sequence><xs:element name='b' minOccurs='0' maxOccurs='unbounded'/></xs:sequence></xs:complexType>"
    + "<xs:notation name='gif' public='image/gif'/>"
    + "<xs:element name='item' abstract='true' type='line'/><xs:element name='present' substitutionGroup='item' type='gift' nillable='true'/><xs:element name='box' block='extension'><xs:complexType><xs:sequence><xs:element ref='item' maxOccurs='9'/></xs:sequence></xs:complexType><xs:key name='k'><xs:selector xpath='item|present'/><xs:field xpath='@n'/></xs:key><xs:keyref name='r' refer='k'><xs:selector xpath='.//item'/><xs:field xpath='@to'/></xs:keyref></xs:element>"
)


@cases("name string, kind string, variety string, base string", [
    ("money", "simple", "atomic", "decimal"), ("ints", "simple", "list", "anySimpleType"), ("num", "simple", "union", "anySimpleType"),
    ("line", "complex", "element-only", "anyType"), ("gift", "complex", "element-only", "line"), ("amount", "complex", "simple", "money"), ("nothing", "complex", "empty", "anyType"), ("prose", "complex", "mixed", "anyType"),
])
def catalogue_types(spark, sf):
    t = compile_text(SHOP).catalog(spark)["types"]
    return t.select("name", "kind", "variety", F.regexp_replace("base", r"^\{.*\}", "").alias("base"))


@cases("name string, type string, abstract boolean, nillable boolean", [("item", "line", True, False), ("present", "gift", False, True), ("box", None, False, False)])
def catalogue_elements(spark, sf):
    return compile_text(SHOP).catalog(spark)["elements"].select("name", "type", "abstract", "nillable")


@cases("type string, name string, required boolean, default_ string, fixed string", [("line", "n", True, None, None), ("line", "unit", False, "EUR", None), ("gift", "n", True, None, None), ("gift", "unit", False, "EUR", None), ("gift", "to", False, None, None), ("amount", "cur", False, None, "EUR")])
def catalogue_attributes(spark, sf):
    return compile_text(SHOP).catalog(spark)["attributes"].select("type", "name", "required", F.col("default").alias("default_"), "fixed")


@cases("name string, kind string, selector string, fields string, refer string", [("k", "key", "item|present", "@n", None), ("r", "keyref", ".//item", "@to", "k")])
def catalogue_constraints(spark, sf):
    return compile_text(SHOP).catalog(spark)["constraints"].select("name", "kind", "selector", F.array_join("fields", " ").alias("fields"), "refer")


@cases("head string, member string", [("item", "item"), ("item", "present"), ("present", "present"), ("box", "box")])
def catalogue_substitutions(spark, sf):
    return compile_text(SHOP).catalog(spark)["substitutions"]


@cases("sub string, super string, way string", [("gift", "line", "extension"), ("line", "gift", None), ("gift", "anyType", "extension restriction"), ("amount", "decimal", "extension restriction"), ("byte", "integer", "restriction restriction restriction restriction"), ("byte", "string", None), ("int", "num", ""), ("money", "num", ""), ("date", "num", None), ("line", "line", "")])
def subtype_test(spark, sf):
    s = compile_text(SHOP)
    get = lambda n: s.types.get(("", n)) or s.types[(XMAP["xs"], n)]
    pairs = [("gift", "line"), ("line", "gift"), ("gift", "anyType"), ("amount", "decimal"), ("byte", "integer"), ("byte", "string"), ("int", "num"), ("money", "num"), ("date", "num"), ("line", "line")]
    rows = [(a, b, None if (w := s.derivation(get(a), get(b))) is None else " ".join(w)) for a, b in pairs]
    return by_case(spark, rows, "sub string, super string, way string")


@cases("name string, rule string", [("a model", "ok"), ("twice", "sch-props-correct"), ("no notation", "n-props-correct"), ("checked like a compiled one", "cos-nonambig")])
def direct_construction(spark, sf):
    def of(make) -> str:
        try:
            make()
        except SchemaError as e:
            return e.rule
        return "ok"

    a = lambda low=1: Particle(Occurs(low, 1), ElementDecl(("", "a"), B["int"]))
    t = lambda *ps: ComplexType(("", "t"), None, variety="element-only", particle=Particle(Occurs(), Group("sequence", list(ps))))
    rows = [
        ("a model", of(lambda: SchemaBuilder().type(("", "t"), t(a())).element(ElementDecl(("", "r"), B["int"])).attribute(Attribute(("", "p"), B["date"])).build())),
        ("twice", of(lambda: SchemaBuilder().element(ElementDecl(("", "r"), B["int"])).element(ElementDecl(("", "r"), B["int"])))),
        ("no notation", of(lambda: SchemaBuilder().notation(("", "n")))),
        ("checked like a compiled one", of(lambda: SchemaBuilder().type(("", "t"), t(a(0), a())).build())),
    ]
    return by_case(spark, rows, "name string, rule string")


# wildcards and occurrence -----------------------------------------------------

ONE, TWO = NamespaceConstraint("enumeration", frozenset("ab")), NamespaceConstraint("not", frozenset("bc"))
ALGEBRA = [("any", "any", "abcd", "abcd", "", True), ("any", "ab", "abcd", "ab", "cd", False), ("ab", "any", "abcd", "ab", "", True), ("ab", "ab", "ab", "ab", "", True), ("ab", "not bc", "abd", "a", "b", False), ("not bc", "ab", "abd", "a", "d", False), ("not bc", "not bc", "ad", "ad", "", True), ("not bc", "any", "abcd", "ad", "", True), ("any", "not bc", "abcd", "ad", "bc", False)]


@cases("a string, b string, in_either string, in_both string, only_a string, inside boolean", ALGEBRA)
def wildcard_algebra(spark, sf):
    named = {"any": ANY, "ab": ONE, "not bc": TWO}
    show = lambda c: "".join(n for n in "abcd" if c.allows(n))
    return by_case(spark, [(a, b, show(union(x, y)), show(intersect(x, y)), show(less(x, y)), subset(x, y)) for a, b, *_ in ALGEBRA for x, y in [(named[a], named[b])]], "a string, b string, in_either string, in_both string, only_a string, inside boolean")


@cases("text string, admitted string", [("##any", "(none) t u"), ("##other", "u"), ("##targetNamespace", "t"), ("##local", "(none)"), ("##targetNamespace ##local", "(none) t"), ("u", "u"), ("not t", "(none) u"), ("not ##local", "t u")])
def wildcard_forms(spark, sf):
    rows = []
    for text in ("##any", "##other", "##targetNamespace", "##local", "##targetNamespace ##local", "u", "not t", "not ##local"):
        c = parse(None, text[4:], "t") if text.startswith("not ") else parse(text, None, "t")
        rows.append((text, " ".join(n or "(none)" for n in ("", "t", "u") if c.allows(n))))
    return by_case(spark, rows, "text string, admitted string")


@cases("ns string, name string, admitted boolean", [("t", "x", False), ("u", "x", False), ("u", "y", True), ("", "y", False), ("", "x", True), ("v", "s", False)])
def wildcard_names(spark, sf):
    w = Wildcard(NamespaceConstraint("not", frozenset(["t"])), disallowed=frozenset([("u", "x")]), defined=True, sibling=True)
    df = by_case(spark, [("t", "x"), ("u", "x"), ("u", "y"), ("", "y"), ("", "x"), ("v", "s")], "ns string, name string")
    return df.select("ns", "name", w.column(F.col("ns"), F.col("name"), frozenset([("", "y")]), frozenset([("v", "s")])).alias("admitted"))


@cases("what string, low long, high long", [("1..2 then 0..*", 1, None), ("2..3 times 1..4", 2, 12), ("0..* times 0..0", 0, 0), ("1..2 or 3..5", 1, 5), ("1..1 or 0..*", 0, None)])
def occurrence_algebra(spark, sf):
    rows = [("1..2 then 0..*", Occurs(1, 2).plus(Occurs(0, None))), ("2..3 times 1..4", Occurs(2, 3).times(Occurs(1, 4))), ("0..* times 0..0", Occurs(0, None).times(Occurs(0, 0))), ("1..2 or 3..5", Occurs(1, 2).either(Occurs(3, 5))), ("1..1 or 0..*", Occurs(1, 1).either(Occurs(0, None)))]
    return by_case(spark, [(n, o.low, o.high) for n, o in rows], "what string, low long, high long")


# content models ----------------------------------------------------------------

CONTENT = {
    "order": (SEQ("<xs:element name='a'/><xs:element name='b' minOccurs='0'/><xs:element name='c' maxOccurs='2'/>"), {"ac": None, "abcc": None, "a": "short", "abccc": 4, "ba": 0, "": "short"}),
    "repeated choice": ("<xs:choice minOccurs='2' maxOccurs='3'><xs:element name='a'/><xs:element name='b'/></xs:choice>", {"ab": None, "aba": None, "a": "short", "abab": 3}),
    "all": ("<xs:all><xs:element name='a'/><xs:element name='b' minOccurs='0'/><xs:element name='c' maxOccurs='2'/></xs:all>", {"cac": None, "bca": None, "a": "short", "aa": 1}),
    "wildcard": (SEQ("<xs:element name='a'/><xs:any namespace='##any' processContents='skip' minOccurs='0'/>"), {"a": None, "az": None, "azz": 2}),
    "nested": (SEQ("<xs:choice minOccurs='0' maxOccurs='unbounded'><xs:sequence><xs:element name='a'/><xs:element name='b'/></xs:sequence><xs:element name='c'/></xs:choice><xs:element name='d'/>"), {"d": None, "abcabd": None, "acd": 1, "abc": "short"}),
    "optional": (SEQ("<xs:element name='a' minOccurs='0'/>"), {"": None, "a": None, "aa": 1}),
    "nothing": ("<xs:sequence/>", {"": None, "a": 0}),
}
CONTENT_ROWS = [(m, k, w is None, w if isinstance(w, int) else None, w == "short") for m, (_, ks) in CONTENT.items() for k, w in ks.items()]


@cases("model string, children string, ok boolean, reject_index long, too_short boolean", CONTENT_ROWS)
def content_models(spark, sf):
    df = by_case(spark, [(m, k, list(k)) for m, (_, ks) in CONTENT.items() for k in ks], "model string, children string, names array<string>")
    v = F.lit(None).cast("struct<ok: boolean, reject_index: int, too_short: boolean>")
    for m, (text, _) in CONTENT.items():
        s = compile_text(schema(MODEL(text, "t")))
        one = automaton(s.types[("", "t")], s).verdict(F.col("names"))
        v = F.when(F.col("model") == m, F.struct(one["ok"].alias("ok"), one["reject_index"].cast("int").alias("reject_index"), one["too_short"].alias("too_short"))).otherwise(v)
    return df.withColumn("v", v).select("model", "children", "v.ok", F.col("v.reject_index").cast("long").alias("reject_index"), "v.too_short")


INCLUSION = [("a?", "a*", True), ("a*", "a?", False), ("ab", "a(b|c)", True), ("a(b|c)", "ab", False), ("a{2,3}", "a{1,5}", True), ("a{2,6}", "a{1,5}", False), ("", "a?", True), ("(ab)*", "(a|b)*", True)]


@cases("narrow string, wide string, inside boolean", INCLUSION)
def content_inclusion(spark, sf):
    e = lambda n, low=1, high=1: f"<xs:element name='{n}' minOccurs='{low}' maxOccurs='{high}'/>"
    many = "minOccurs='0' maxOccurs='unbounded'"
    model = {
        "a?": SEQ(e("a", 0)), "a*": SEQ(e("a", 0, "unbounded")), "ab": SEQ(e("a") + e("b")), "a(b|c)": SEQ(e("a") + f"<xs:choice>{e('b')}{e('c')}</xs:choice>"), "a{2,3}": SEQ(e("a", 2, 3)), "a{2,6}": SEQ(e("a", 2, 6)), "a{1,5}": SEQ(e("a", 1, 5)), "": "<xs:sequence/>",
        "(ab)*": f"<xs:sequence {many}>{e('a')}{e('b')}</xs:sequence>", "(a|b)*": f"<xs:choice {many}>{e('a')}{e('b')}</xs:choice>",
    }
    made = {k: automaton((s := compile_text(schema(MODEL(t, "t")))).types[("", "t")], s) for k, t in model.items()}
    return by_case(spark, [(a, b, included(made[a], made[b])) for a, b, _ in INCLUSION], "narrow string, wide string, inside boolean")


# datatypes --------------------------------------------------------------------

LITERALS = {
    "numbers": {
        "boolean": {"true": "true", "0": "false", " 1 ": "true", "True": None, "": None, "2": None},
        "decimal": {"-1.23": "-1.23", "12678967.543233": "12678967.543233", "+100000.00": "100000", "210": "210", "-0.0": "0", ".5": "0.5", "-1.23E2": None, "+": None, ".": None, "": None},
        "integer": {"+007": "7", "-0": "0", "1.0": None}, "byte": {"-128": "-128", "128": None}, "unsignedByte": {"255": "255", "-1": None}, "positiveInteger": {"1": "1", "0": None},
        "double": {"INF": "INF", "-INF": "-INF", "NaN": "NaN", "0": "0.0E0", "-0": "-0.0E0", "100": "1.0E2", "1.5": "1.5E0", "12.78e-2": "1.278E-1", "1e400": "INF", "+NaN": None, "Infinity": None, "1.5e": None, "++1": None},
        "float": {"123456789": "1.23456792E8", "1e99": "INF", "0.1": "1.0E-1"},
        "precisionDecimal": {"3.00": "3.00", "1E-2": "0.01", "-1.50E8": "-1.50E8", "INF": "INF", "x": None},
    },
    "calendar": {
        "dateTime": {"2001-10-26T21:32:52.1250": "2001-10-26T21:32:52.125", "2001-12-31T24:00:00Z": "2002-01-01T00:00:00Z", "2000-02-28T24:00:00": "2000-02-29T00:00:00", "2001-10-26T21:32:52.0000000000000000100": "2001-10-26T21:32:52.00000000000000001", "2023-02-29T00:00:00": None, "2023-13-01T00:00:00": None, "2023-01-01T25:00:00": None, "2023-01-0100:00:00": None},
        "dateTimeStamp": {"2001-10-26T21:32:52Z": "2001-10-26T21:32:52Z", "2001-10-26T21:32:52": None},
        "time": {"13:20:00": "13:20:00", "24:00:00": "00:00:00", "13:20:00.10+02:00": "13:20:00.1+02:00", "25:00:00": None, "13:20:00+15:00": None, "13:20": None},
        "date": {"2024-02-29": "2024-02-29", "2002-10-10-00:00": "2002-10-10Z", "2002-10-10+02:00": "2002-10-10+02:00", "2023-02-29": None, "2002-1-01": None},
        "gYearMonth": {"2002-10": "2002-10", "-0045-03": "-0045-03", "2002-13": None, "2002": None}, "gYear": {"2002Z": "2002Z", "12345": "12345", "999": None, "02002": None},
        "gMonthDay": {"--02-29": "--02-29", "--12-12+13:00": "--12-12+13:00", "--02-30": None, "10-10": None}, "gDay": {"---31": "---31", "---15-13:00": "---15-13:00", "---00": None, "---32": None}, "gMonth": {"--01": "--01", "--05Z": "--05Z", "--13": None},
    },
    "durations": {
        "duration": {"P1Y": "P1Y", "P13M": "P1Y1M", "PT36H": "P1DT12H", "-P0D": "PT0S", "PT1.50S": "PT1.5S", "P1Y2M3DT4H5M6S": "P1Y2M3DT4H5M6S", "P0M": "PT0S", "P": None, "PT": None, "P1S": None, "1Y": None, "PT1D": None, "P-1Y": None},
        "yearMonthDuration": {"P1Y": "P1Y", "-P25M": "-P2Y1M", "P1D": None}, "dayTimeDuration": {"PT90M": "PT1H30M", "-PT24H": "-P1D", "P0D": "PT0S", "P1M": None},
    },
    "texts": {
        "string": {"a  b": "a  b", "": ""}, "normalizedString": {"a\tb": "a b"}, "token": {" a  b ": "a b"}, "language": {"en-GB": "en-GB", "toolongtag1": None}, "Name": {"a:b": "a:b", "1a": None}, "NCName": {"_a.1": "_a.1", "a:b": None, "": None},
        "NMTOKEN": {"1-a": "1-a", "a b": None}, "NMTOKENS": {" a  b ": "a b", "": None}, "anyURI": {" http://x/a b ": "http://x/a b", "": ""}, "hexBinary": {"0fb7": "0FB7", "": "", "F": None, "0G": None}, "base64Binary": {"AQ ==": "AQ==", "TWFu": "TWFu", "AQI": None, "AB==": None, "A===": None}, "ID": {"x1": "x1", "1x": None},
    },
}


def literal_rows(family: str) -> list[tuple]:
    return [(t, a, c is not None, c) for t, rows in LITERALS[family].items() for a, c in rows.items()]


def _literals(family: str) -> Query:
    def run(spark, sf):
        # a type's expression is evaluated on its own rows only
        df = by_case(spark, [(t, a) for t, a, _, _ in literal_rows(family)], "type string, literal string").coalesce(1)
        v = F.lit(None).cast("struct<ok: boolean, canonical: string>")
        for t in LITERALS[family]:
            one = verdict(F.col("literal"), B[t])
            v = F.when(F.col("type") == t, F.struct(one["ok"].alias("ok"), one["canonical"].alias("canonical"))).otherwise(v)
        return df.withColumn("v", v).select("type", "literal", "v.ok", "v.canonical")

    run.__name__ = f"literals_{family}"
    return run


for _family in LITERALS:
    cases("type string, literal string, ok boolean, canonical string", literal_rows(_family))(_literals(_family))

ORDERS = {
    "duration": [("P1M", "P30D", "open"), ("P1M", "P31D", "open"), ("P1M", "P27D", "greater"), ("P1M", "P32D", "less"), ("P1Y", "P12M", "equal"), ("PT36H", "P1DT12H", "equal"), ("-P1M", "-P40D", "greater"), ("P5M", "P150D", "open"), ("P1Y", "P364D", "greater")],
    "dateTime": [("2002-10-10T12:00:00-05:00", "2002-10-10T17:00:00Z", "equal"), ("2002-10-10T12:00:00", "2002-10-10T17:00:00Z", "open"), ("2002-10-09T12:00:00", "2002-10-10T17:00:00Z", "less"), ("2002-10-11T12:00:00", "2002-10-10T17:00:00Z", "greater"), ("-0001-01-01T00:00:00", "0001-01-01T00:00:00", "less"), ("2000-12-31T24:00:00", "2001-01-01T00:00:00", "equal")],
    "time": [("24:00:00", "00:00:00", "equal"), ("12:00:00+01:00", "11:30:00Z", "less"), ("23:59:59", "00:00:00", "greater")],
    "gMonthDay": [("--02-28", "--03-01", "less"), ("--12-31", "--12-31Z", "open")],
    "double": [("NaN", "NaN", "open"), ("-0", "0", "equal"), ("INF", "1e308", "greater")],
    "decimal": [("0.10", "0.1", "equal"), ("100000000000000000000000000000000000000000.1", "100000000000000000000000000000000000000000.01", "greater"), ("-2", "-10", "greater")],
    "precisionDecimal": [("3.0", "3.00", "equal"), ("1E2", "99.9", "greater"), ("-INF", "-1E99", "less"), ("NaN", "1", "open")],
}


def _compared(spark: SparkSession, orders: dict) -> DataFrame:
    df = by_case(spark, [(t, a, b) for t, rows in orders.items() for a, b, _ in rows], "type string, a string, b string").coalesce(1)
    v = F.lit(None).cast("int")
    for t in orders:
        v = F.when(F.col("type") == t, V.compare(F.col("a"), F.col("b"), t)).otherwise(v)
    return df.withColumn("v", v).select("type", "a", "b", F.when(F.col("v") < 0, "less").when(F.col("v") > 0, "greater").when(F.col("v") == 0, "equal").otherwise("open").alias("order_"))


ORDER_DDL = "type string, a string, b string, order_ string"


@cases(ORDER_DDL, [(t, *r) for t, rows in ORDERS.items() for r in rows])
def partial_orders(spark, sf):
    return _compared(spark, ORDERS)


LONG_DURATIONS = {"duration": [("P1000000000000000000000D", "P1M", "greater"), ("P1000000000000000000000D", "P1000000000000000000001D", "less"), ("PT0.0000000000001S", "PT0S", "greater"), ("-PT0.0000000000001S", "PT0S", "less"), ("PT1.00000000000000000002S", "PT1.00000000000000000003S", "less"), ("-PT1.00000000000000000002S", "-PT1.00000000000000000003S", "greater"), ("PT86400.00000000000000000001S", "P1D", "greater"), ("P1000000000000M", "P1000000000001M", "less"), ("PT1.50S", "PT1.5S", "equal")]}


@cases(ORDER_DDL, [(t, *r) for t, rows in LONG_DURATIONS.items() for r in rows])
def duration_long_digits(spark, sf):
    return _compared(spark, LONG_DURATIONS)


FRACTIONS = {
    "dateTime": [("2024-01-01T00:00:00.0000000000001Z", "2024-01-01T00:00:00Z", "greater"), ("2024-01-01T00:00:00.00000000000000000012Z", "2024-01-01T00:00:00.00000000000000000013Z", "less"), ("2024-01-01T00:00:00.10Z", "2024-01-01T00:00:00.1Z", "equal"), ("1234567890123-01-01T00:00:00Z", "1234567890123-01-01T00:00:00.00000000000001Z", "less"), ("-0045-01-01T00:00:00.00000000000001Z", "-0045-01-01T00:00:00Z", "greater")],
    "time": [("12:00:00.00000000000000001", "12:00:00", "greater")],
}


@cases(ORDER_DDL, [(t, *r) for t, rows in FRACTIONS.items() for r in rows])
def datetime_fraction(spark, sf):
    return _compared(spark, FRACTIONS)


@cases("literal string, canonical string", [("P1000000000000000000000D", "P1000000000000000000000D"), ("PT86400.00000000000000000001S", "P1DT0.00000000000000000001S"), ("PT10000000000000000000000S", "P115740740740740740DT17H46M40S"), ("P100000000000000M", "P8333333333333Y4M")])
def duration_long_forms(spark, sf):
    df = by_case(spark, [("P1000000000000000000000D",), ("PT86400.00000000000000000001S",), ("PT10000000000000000000000S",), ("P100000000000000M",)], "literal string")
    return df.select("literal", verdict(F.col("literal"), B["duration"])["canonical"].alias("canonical"))


FIXED = [("decimal", "1.5", "1.50", True), ("decimal", "1.5", "2", False), ("double", "NaN", "NaN", True), ("dateTime", "2002-10-10T17:00:00Z", "2002-10-10T12:00:00-05:00", True), ("string", "a", "a ", False), ("token", "a", " a ", True), ("decimal", "1", "x", None)]


@cases("type string, fixed string, literal string, agrees boolean", FIXED)
def fixed_values(spark, sf):
    df = by_case(spark, [(t, f, a) for t, f, a, _ in FIXED], "type string, fixed string, literal string").coalesce(1)
    v = F.lit(None).cast("boolean")
    for t, f, _, _ in FIXED:
        v = F.when((F.col("type") == t) & (F.col("fixed") == f), matches_fixed(F.col("literal"), f, B[t])).otherwise(v)
    return df.select("type", "fixed", "literal", v.alias("agrees"))


@cases("type string, base string, white_space string, variety string", [
    ("string", "anyAtomicType", "preserve", "atomic"), ("normalizedString", "string", "replace", "atomic"), ("token", "normalizedString", "collapse", "atomic"), ("language", "token", "collapse", "atomic"), ("NMTOKEN", "token", "collapse", "atomic"), ("Name", "token", "collapse", "atomic"), ("NCName", "Name", "collapse", "atomic"), ("ID", "NCName", "collapse", "atomic"), ("IDREF", "NCName", "collapse", "atomic"), ("ENTITY", "NCName", "collapse", "atomic"),
    ("integer", "decimal", "collapse", "atomic"), ("nonPositiveInteger", "integer", "collapse", "atomic"), ("negativeInteger", "nonPositiveInteger", "collapse", "atomic"), ("long", "integer", "collapse", "atomic"), ("int", "long", "collapse", "atomic"), ("short", "int", "collapse", "atomic"), ("byte", "short", "collapse", "atomic"), ("nonNegativeInteger", "integer", "collapse", "atomic"), ("unsignedLong", "nonNegativeInteger", "collapse", "atomic"), ("unsignedInt", "unsignedLong", "collapse", "atomic"), ("unsignedShort", "unsignedInt", "collapse", "atomic"), ("unsignedByte", "unsignedShort", "collapse", "atomic"), ("positiveInteger", "nonNegativeInteger", "collapse", "atomic"),
    ("yearMonthDuration", "duration", "collapse", "atomic"), ("dayTimeDuration", "duration", "collapse", "atomic"), ("dateTimeStamp", "dateTime", "collapse", "atomic"), ("IDREFS", "anySimpleType", "collapse", "list"), ("NMTOKENS", "anySimpleType", "collapse", "list"), ("ENTITIES", "anySimpleType", "collapse", "list"),
])
def builtin_derivations(spark, sf):
    rows = [(n, t.base.name if t.base is not None else None, t.white_space(), t.variety) for n, t in B.items() if t.base is not None and (t.base.name != "anyAtomicType" or n == "string") and n not in ("anySimpleType", "anyAtomicType", "error")]
    return by_case(spark, rows, "type string, base string, white_space string, variety string")


@cases("type string, facets string", [("string", "assertions enumeration length maxLength minLength pattern whiteSpace"), ("boolean", "assertions pattern whiteSpace"), ("decimal", "assertions enumeration fractionDigits maxExclusive maxInclusive minExclusive minInclusive pattern totalDigits whiteSpace"), ("dateTime", "assertions enumeration explicitTimezone maxExclusive maxInclusive minExclusive minInclusive pattern whiteSpace"), ("list", "assertions enumeration length maxLength minLength pattern whiteSpace"), ("union", "assertions enumeration pattern")])
def facet_applicability(spark, sf):
    return by_case(spark, [(k, " ".join(sorted({*APPLICABLE[k], "assertions"}))) for k in ("string", "boolean", "decimal", "dateTime", "list", "union")], "type string, facets string")


# patterns ---------------------------------------------------------------------

PATTERNS = [
    (r"\d", "xsd", "", "٣", True), (r"\d", "xsd", "", "a", False), (r"[a-z-[aeiou]]+", "xsd", "", "xyz", True), (r"[a-z-[aeiou]]+", "xsd", "", "xaz", False), (r"[a-z-[a-c-[b]]]", "xsd", "", "b", True), (r"[a-z-[a-c-[b]]]", "xsd", "", "a", False),
    (r"a.c", "xsd", "", "a\nc", False), (r"^a$", "xsd", "", "^a$", True), (r"\p{Lu}{2}", "xsd", "", "ÄB", True), (r"\P{Lu}", "xsd", "", "a", True), (r"\p{IsBasicLatin}+", "xsd", "", "az", True), (r"\p{IsBasicLatin}+", "xsd", "", "aé", False), (r"\p{IsGreek}+", "xsd", "", "αβ", True), (r"\i\c*", "xsd", "", "a-b.c", True), (r"\i\c*", "xsd", "", "-a", False), (r"[^\s]+", "xsd", "", "a b", False),
    (r"a{2,3}", "xsd", "", "aaaa", False), (r"(a|b)*c?", "xsd", "", "abba", True), (r"", "xsd", "", "", True), (r"a b", "fo", "ix", "xABx", True), (r"^b$", "fo", "m", "a\nb", True), (r"a.b", "fo", "s", "a\nb", True), (r"^b", "fo", "", "ab", False), (r"A+?", "fo", "i", "xa", True),
]


@cases("pattern string, flavor string, flags string, text string, matches boolean", PATTERNS)
def pattern_cases(spark, sf):
    df = by_case(spark, [(i, *r[:4]) for i, r in enumerate(PATTERNS)], "i int, pattern string, flavor string, flags string, text string").coalesce(1)
    v = F.lit(None).cast("boolean")
    for i, (p, flavor, flags, _, _) in enumerate(PATTERNS):
        v = F.when(F.col("i") == i, F.col("text").rlike(translate(p, flavor, flags))).otherwise(v)
    return df.select("pattern", "flavor", "flags", "text", v.alias("matches"))


BAD_PATTERNS = [("(", "src-pattern-value"), (r"\1", "src-pattern-value"), ("a{3,1}", "src-pattern-value"), ("a{1001}", "src-pattern-value"), (r"\p{Foo}", "src-pattern-value"), (r"\p{IsFoo}", "src-pattern-value"), ("[a", "src-pattern-value"), ("*a", "src-pattern-value"), ("a)", "src-pattern-value"), ("[b-a]", "src-pattern-value"), ("a{2}", "ok"), (r"\-\.\?", "ok"), ("[a-]", "ok")]


@cases("pattern string, rule string", BAD_PATTERNS)
def pattern_errors(spark, sf):
    def of(p: str) -> str:
        try:
            translate(p)
        except PatternError as e:
            return e.rule
        return "ok"

    return by_case(spark, [(p, of(p)) for p, _ in BAD_PATTERNS], "pattern string, rule string")


@cases("what string, n long", [("digits of two scripts", 20), ("both", 3), ("a to f without vowels", 4), ("either", 8), ("all but one", 1114111), ("controls", 65)])
def range_sets(spark, sf):
    size = lambda s: sum(b - a + 1 for a, b in s)
    rows = [
        ("digits of two scripts", size(intersection(category("Nd"), ((48, 57), (0x660, 0x669))))), ("both", size(intersection(((1, 5),), ((3, 9),)))), ("a to f without vowels", size(difference(((97, 102),), chars("aeiou")))),
        ("either", size(either(((1, 5),), ((3, 8),)))), ("all but one", size(complement(((65, 65),)))), ("controls", size(category("Cc"))),
    ]
    return by_case(spark, rows, "what string, n long")


# documents --------------------------------------------------------------------

ORDER = f"""<xs:schema {XS}>
<xs:simpleType name="money"><xs:restriction base="xs:decimal"><xs:minInclusive value="0"/><xs:fractionDigits value="2"/></xs:restriction></xs:simpleType>
<xs:complexType name="lineT"><xs:sequence><xs:element name="part" type="xs:int"/><xs:element name="price" type="money"/></xs:sequence><xs:attribute name="n" type="xs:positiveInteger" use="required"/><xs:attribute name="unit" type="xs:string" fixed="EUR"/></xs:complexType>
<xs:complexType name="giftT"><xs:complexContent><xs:extension base="lineT"><xs:sequence><xs:element name="note" type="xs:string"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType>
<xs:complexType name="sized"><xs:simpleContent><xs:extension base="xs:int"><xs:attribute name="u"/></xs:extension></xs:simpleContent></xs:complexType>
<xs:element name="ghost" abstract="true"/>
<xs:element name="order"><xs:complexType><xs:sequence><xs:element name="id" type="xs:ID"/><xs:element name="see" type="xs:IDREF" minOccurs="0"/><xs:element name="line" type="lineT" maxOccurs="unbounded"/><xs:element name="status" type="xs:string" nillable="true" minOccurs="0"/><xs:element name="size" type="sized" minOccurs="0"/><xs:element name="rate" type="xs:decimal" fixed="1.5" minOccurs="0"/><xs:any namespace="urn:skip" processContents="skip" minOccurs="0"/></xs:sequence></xs:complexType></xs:element>
</xs:schema>"""


def _line(n="1", part="5", price="1.50", more="", attrs=""):
    return f'<line n="{n}" {attrs}><part>{part}</part><price>{price}</price>{more}</line>'


def _order(body, see=""):
    return f"<order {XSI}><id>a</id>{see}{body}</order>"


DOCUMENTS = {
    "good": (_order(_line() + _line("2")), []),
    "a derived type": (_order(_line(more="<note>x</note>", attrs='xsi:type="giftT"')), []),
    "an unrelated type": (_order(_line(attrs='xsi:type="money"')), ["cvc-elt 4"]),
    "a value": (_order(_line(part="x")), ["cvc-type 3.1.3"]),
    "a facet": (_order(_line(price="-1")), ["cvc-type 3.1.3"]),
    "an attribute's value": (_order(_line(n="0")), ["cvc-attribute 3"]),
    "an attribute nobody knows": (_order(_line(attrs='zz="1"')), ["cvc-complex-type 2"]),
    "an attribute missing": (_order("<line><part>1</part><price>2</price></line>"), ["cvc-complex-type 3"]),
    "an element too many": (_order(_line() + "<zz><part>x</part></zz>"), ["cvc-complex-content reject"]),
    "too few elements": (_order(""), ["cvc-complex-content short"]),
    "text between elements": (_order("hello" + _line()), ["cvc-complex-type 1.3"]),
    "nilled": (_order(_line() + '<status xsi:nil="true"/>'), []),
    "nilled with content": (_order(_line() + '<status xsi:nil="true">x</status>'), ["cvc-elt 3.2.3.1"]),
    "nilled where it may not": (_order(_line(attrs='xsi:nil="true"')), ["cvc-elt 3.1"]),
    "simple content": (_order(_line() + '<size u="cm">7</size>'), []),
    "bad simple content": (_order(_line() + '<size u="cm">x</size>'), ["cvc-complex-type 1.2"]),
    "an element in simple content": (_order(_line() + "<size>7<b/></size>"), ["cvc-complex-type 1.2"]),
    "fixed": (_order(_line() + "<rate>1.50</rate>"), []),
    "not the fixed value": (_order(_line() + "<rate>2</rate>"), ["cvc-elt 5.2.2.2.2"]),
    "skipped": (_order(_line() + '<s:x xmlns:s="urn:skip"><part>x</part></s:x>'), []),
    "an undeclared root": ("<other/>", ["cvc-assess-elt "]),
    "an abstract root": ("<ghost/>", ["cvc-elt 2"]),
    "not well-formed": ("<order><id></order>", ["xml-wf "]),
    "a reference": (_order(_line(), see="<see>a</see>"), []),
    "a dangling reference": (_order(_line(), see="<see>b</see>"), ["cvc-id 1"]),
}


def _assessed(spark: SparkSession, text: str, documents: dict, rule: str | None = None) -> DataFrame:
    docs = by_case(spark, [(k, v[0]) for k, v in documents.items()], "doc_id string, xml string")
    made = Assessment(compile_text(text)).assess(shred(docs, "doc_id", "xml"))
    if rule:
        made = made.where(F.col("rule") == rule)
    return _found(docs, made)


def _found(docs: DataFrame, made: DataFrame) -> DataFrame:
    found = made.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "rule", "clause"))), ", ").alias("found"))
    return docs.select(F.col("doc_id").alias("name")).join(found, F.col("name") == F.col("doc_id"), "left").select("name", F.coalesce("found", F.lit("")).alias("found"))


@cases("name string, found string", [(k, ", ".join(v[1])) for k, v in DOCUMENTS.items()])
def assess_cases(spark, sf):
    return _assessed(spark, ORDER, DOCUMENTS)


JSON = {
    "good": ('{"id": "a", "line": [{"n": 1, "part": 5, "price": 1.50}, {"n": 2, "part": 5, "price": 1e0}]}', ["cvc-type 3.1.3"]),
    "digits as written": ('{"id": "a", "line": {"n": 1, "part": 5, "price": 1.500}}', []),
    "too many digits": ('{"id": "a", "line": {"n": 1, "part": 5, "price": 1.505}}', ["cvc-type 3.1.3"]),
    "one line without an array": ('{"id": "a", "line": {"n": 1, "part": 5, "price": 1}}', []),
    "a derived type": ('{"id": "a", "line": {"$type": "giftT", "n": 1, "part": 5, "price": 1, "note": "x"}}', []),
    "an unrelated type": ('{"id": "a", "line": {"$type": "money", "n": 1, "part": 5, "price": 1}}', ["cvc-elt 4"]),
    "an attribute missing": ('{"id": "a", "line": {"part": 5, "price": 1}}', ["cvc-complex-type 3"]),
    "a member nobody knows": ('{"id": "a", "line": {"n": 1, "part": 5, "price": 1}, "zz": {"part": "x"}}', ["cvc-complex-content reject"]),
    "nilled": ('{"id": "a", "line": {"n": 1, "part": 5, "price": 1}, "status": null}', []),
    "nilled where it may not": ('{"id": null, "line": {"n": 1, "part": 5, "price": 1}}', ["cvc-elt 3.1", "cvc-type 3.1.3"]),
    "a dangling reference": ('{"id": "a", "see": "b", "line": {"n": 1, "part": 5, "price": 1}}', ["cvc-id 1"]),
    "no JSON": ('{"id": ', ["json-wf "]),
    "no object": ("[1]", ["json-wf "]),
}


@cases("name string, found string", [(k, ", ".join(v[1])) for k, v in JSON.items()])
def json_cases(spark, sf):
    s = compile_text(ORDER)
    docs = by_case(spark, [(k, v[0]) for k, v in JSON.items()], "doc_id string, text string")
    return _found(docs, Assessment(s).assess(shred_json(docs, "doc_id", "text", s, ("", "order"))))


def _tlv(tag: int, contents: bytes) -> bytes:
    n = len(contents)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + contents


_ID, _BAD_ID = _tlv(0x0C, b"a"), _tlv(0x0C, b"\xff")
_PART = _tlv(0x30, _tlv(0x02, b"\x05") + _tlv(0x81, b"7.50"))
_LONG = _tlv(0x30, _tlv(0x02, b"\x05") + _tlv(0x81, b"0" * 300 + b"1"))
TAGS = {"": {(0, 16): ("order", "none")}, "order": {(0, 12): ("id", "text"), (0, 16): ("line", "none")}, "line": {(0, 2): ("part", "integer"), (2, 1): ("price", "text")}}
TLV = schema("<xs:element name='order'><xs:complexType><xs:sequence><xs:element name='id' type='xs:ID'/><xs:element name='line' maxOccurs='9'><xs:complexType><xs:sequence><xs:element name='part' type='xs:positiveInteger'/><xs:element name='price' type='xs:decimal'/></xs:sequence></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element>")
BER = {
    "good": (_tlv(0x30, _ID + _PART + _PART), []),
    "a long length": (_tlv(0x30, _ID + _LONG), []),
    "lengths left open": (b"\x30\x80" + _ID + b"\x30\x80" + _tlv(0x02, b"\x05") + _tlv(0x81, b"1") + b"\0\0" + b"\0\0", []),
    "a negative number": (_tlv(0x30, _ID + _tlv(0x30, _tlv(0x02, b"\xfb") + _tlv(0x81, b"1"))), ["cvc-type 3.1.3"]),
    "a tag nobody knows": (_tlv(0x30, _ID + _PART + _tlv(0x9F, b"")), ["ber-wf "]),
    "another tag nobody knows": (_tlv(0x30, _ID + _PART + _tlv(0x85, b"x")), ["cvc-complex-content reject"]),
    "too short": (_tlv(0x30, _ID), ["cvc-complex-content short"]),
    "cut off": (_tlv(0x30, _ID + _PART)[:-1], ["ber-wf "]),
    "no UTF-8": (_tlv(0x30, _BAD_ID + _PART), ["ber-wf "]),
    "two values": (_tlv(0x30, _ID + _PART) * 2, ["ber-wf "]),
    "nothing": (b"", ["ber-wf "]),
}


@cases("name string, found string", [(k, ", ".join(v[1])) for k, v in BER.items()])
def ber_cases(spark, sf):
    docs = by_case(spark, [(k, v[0]) for k, v in BER.items()], "doc_id string, data binary")
    return _found(docs, Assessment(compile_text(TLV)).assess(shred_ber(docs, "doc_id", "data", TAGS)))


KEYS = f"""<xs:schema {XS}>
<xs:element name="shop"><xs:complexType><xs:sequence><xs:element ref="box" minOccurs="0" maxOccurs="9"/><xs:element name="use" minOccurs="0" maxOccurs="9"><xs:complexType><xs:attribute name="k" type="xs:integer"/></xs:complexType></xs:element></xs:sequence></xs:complexType>
<xs:keyref name="uses" refer="items"><xs:selector xpath="use"/><xs:field xpath="@k"/></xs:keyref></xs:element>
<xs:element name="box"><xs:complexType><xs:sequence><xs:element name="item" minOccurs="0" maxOccurs="9"><xs:complexType><xs:sequence><xs:element name="name" type="xs:string" minOccurs="0" maxOccurs="2"/></xs:sequence><xs:attribute name="k" type="xs:integer"/><xs:attribute name="z" type="xs:string" default="7"/></xs:complexType></xs:element></xs:sequence></xs:complexType>
<xs:key name="items"><xs:selector xpath="item"/><xs:field xpath="@k"/></xs:key>
<xs:unique name="names"><xs:selector xpath=".//item"/><xs:field xpath="name"/><xs:field xpath="@z"/></xs:unique></xs:element>
<xs:element name="codes"><xs:complexType><xs:sequence><xs:element name="code" type="xs:double" nillable="true" maxOccurs="9"/></xs:sequence></xs:complexType>
<xs:key name="codes"><xs:selector xpath="code"/><xs:field xpath="."/></xs:key></xs:element></xs:schema>"""
ID = "cvc-identity-constraint"
_box = lambda *k: f"<box>{''.join(f'<item k=\"{x}\"/>' for x in k)}</box>"
KEYED = {
    "good": (f'<shop>{_box(1, 2)}{_box(3)}<use k="03"/></shop>', []),
    "a key twice": (f"<shop>{_box(1, '01', 1)}</shop>", ["4.2.2", "4.2.2"]),
    "a key without a field": ("<shop><box><item/></box></shop>", ["4.2.1"]),
    "two fields": ('<box><item k="1"><name>a</name></item><item k="2"><name>a</name></item><item k="3"/></box>', ["4.1"]),
    "a default counts": ('<box><item k="1" z="7"><name>a</name></item><item k="2"><name>a</name></item></box>', ["4.1"]),
    "a field of two nodes": ('<box><item k="1"><name>a</name><name>b</name></item></box>', ["3"]),
    "a nillable key": ("<codes><code>1</code></codes>", ["4.2.3"]),
}
REFERRED = {
    "found": (f'<shop>{_box(1)}<use k="1"/></shop>', []),
    "dangling": (f'<shop>{_box(1)}<use k="2"/><use/></shop>', ["4.3"]),
    "no key at all": ('<shop><use k="2"/></shop>', ["4.3"]),
    "a key of two boxes": (f'<shop>{_box(1)}{_box(1)}<use k="1"/></shop>', ["4.3"]),
}


@cases("name string, found string", [(k, ", ".join(f"{ID} {c}" for c in v[1])) for k, v in KEYED.items()])
def assess_identity(spark, sf):
    return _assessed(spark, KEYS, KEYED, ID)


@cases("name string, found string", [(k, ", ".join(f"{ID} {c}" for c in v[1])) for k, v in REFERRED.items()])
def keyref_subtree(spark, sf):
    return _assessed(spark, KEYS, REFERRED, ID)


IDS = f"""<xs:schema {XS}>
<xs:simpleType name="uid"><xs:union memberTypes="xs:ID xs:string"/></xs:simpleType><xs:simpleType name="usi"><xs:union memberTypes="xs:string xs:ID"/></xs:simpleType>
<xs:simpleType name="uref"><xs:union memberTypes="xs:IDREF xs:string"/></xs:simpleType><xs:simpleType name="lur"><xs:list itemType="uref"/></xs:simpleType>
<xs:element name="r"><xs:complexType><xs:sequence><xs:element name="i" maxOccurs="9"><xs:complexType><xs:attribute name="uid" type="uid"/><xs:attribute name="usi" type="usi"/><xs:attribute name="uref" type="uref"/><xs:attribute name="lur" type="lur"/><xs:attribute name="ref" type="xs:IDREF"/></xs:complexType></xs:element>
<xs:element name="d" minOccurs="0"><xs:complexType><xs:attribute name="x" type="xs:ID" default="given"/></xs:complexType></xs:element></xs:sequence></xs:complexType></xs:element></xs:schema>"""
ID_CASES = {
    "twice by a union": ('<r><i uid="a"/><i uid="a"/></r>', ["2"]),
    "a reference to a union's": ('<r><i uid="a"/><i ref="a"/></r>', []),
    "by the string member": ('<r><i uid="1 a"/><i uid="1 a"/></r>', []),
    "string comes first": ('<r><i usi="a"/><i usi="a"/></r>', []),
    "dangling by unions": ('<r><i uref="b" lur="c 1"/></r>', ["1", "1"]),
    "defaulted": ('<r><i ref="given"/><d/></r>', []),
    "not defaulted": ('<r><i ref="given"/><d x="own"/></r>', ["1"]),
}


@cases("name string, found string", [(k, ", ".join(f"cvc-id {c}" for c in v[1])) for k, v in ID_CASES.items()])
def ids_through_unions(spark, sf):
    return _assessed(spark, IDS, ID_CASES)


PATHS = [("item", "1"), ("a/b", "1"), (".//item", "1"), ("item|x:y", "2"), ("*", "1"), (".", "1"), ("x:*", "1"), ("child::a", "1"), ("//a", "declined"), ("a[1]", "declined"), ("@n", "declined"), ("q:a", "declined"), ("a/", "declined"), ("..", "declined")]


@cases("path string, result string", PATHS)
def selector_grammar(spark, sf):
    def of(p: str) -> str:
        try:
            return str(len(compile_path(XPath(p, {"x": "urn:x"}), False)))
        except PathDeclined:
            return "declined"

    return by_case(spark, [(p, of(p)) for p, _ in PATHS], "path string, result string")


CTA = [
    ("@kind = 'book'", "true"), ("@n <= 5", "true"), ("@n = 3", "true"), ("not(@none)", "true"), ("@none or @n", "true"), ("(@kind = 'x' or @n > 2) and @p:q", "true"), ("@n = 3e0 (: note :)", "true"), ("@kind > 3", "false"), ("not(@kind > 3)", "false"), ("xs:integer(@n) = 3", "true"),
    ("@n cast as xs:boolean", "false"), ("@*", "true"), ("@p:*", "true"), ("@*:q = 'z'", "true"), ("'it''s' = @kind", "false"), ("@d < xs:date('2024-01-01')", "true"), ("@a idiv 2", "declined"), ("-@n = 1", "declined"), ("@a = 1 1", "declined"), ("f(@a, 1)", "declined"), ("(: open", "declined"), ("@z:a", "error"),
]


@cases("test string, result string", CTA)
def conditional_cases(spark, sf):
    df = by_case(spark, [(t, [("kind", "book"), ("n", "3"), ("{urn:p}q", "z"), ("d", "2023-05-05")]) for t, _ in CTA], "test string, attrs array<struct<name: string, value: string>>").coalesce(1)
    v = F.lit(None).cast("string")
    for t, _ in CTA:
        try:
            one = compile_test(XPath(t, {**XMAP, "p": "urn:p"}), F.col("attrs")).cast("string")
        except CtaDeclined:
            one = F.lit("declined")
        except StaticError:
            one = F.lit("error")
        v = F.when(F.col("test") == t, one).otherwise(v)
    return df.select("test", v.alias("result"))


# sources ----------------------------------------------------------------------

READ = [
    ("plain", b"<a/>", "ok"), ("unclosed", b"<a", "error"), ("an attribute twice", b"<a b='1' b='2'/>", "error"), ("an unbound prefix", b"<p:a/>", "error"), ("one name by two prefixes", b"<a xmlns:p='u' xmlns:q='u' p:x='1' q:x='2'/>", "error"), ("an entity of its own", b"<!DOCTYPE a [<!ENTITY e 'x'>]><a>&e;</a>", "error"),
    ("another encoding", b"<?xml version='1.0' encoding='latin-1'?><a/>", "error"), ("no UTF-8", b"\xff<a/>", "error"), ("UTF-16", "﻿<a/>".encode("utf-16-le"), "ok"), ("UTF-8 with a mark", b"\xef\xbb\xbf<a/>", "ok"), ("crossed tags", b"<a><b></a></b>", "error"), ("two roots", b"<a/><b/>", "error"), ("nothing", b"", "error"),
]


@cases("name string, result string", [(n, r) for n, _, r in READ])
def reading_cases(spark, sf):
    def of(data: bytes) -> str:
        try:
            read(data)
        except XmlError:
            return "error"
        return "ok"

    return by_case(spark, [(n, of(d)) for n, d, _ in READ], "name string, result string")


INFOSET = '<r xmlns="urn:d" xmlns:p="urn:p" id="1" p:lang="en">a<![CDATA[b]]>&amp;<p:b><c xmlns=""/></p:b>\n <d xmlns:p="urn:q"><p:e/></d></r>'


@cases("node_id long, parent_id long, name string, line long, col long, attrs string, text string", [
    (0, None, "{urn:d}r", 1, 1, "id=1 {urn:p}lang=en", "ab&\n "), (1, 0, "{urn:p}b", 1, 72, "", ""), (2, 1, "c", 1, 77, "", ""), (3, 0, "{urn:d}d", 2, 2, "", ""), (4, 3, "{urn:q}e", 2, 21, "", ""),
])
def infoset(spark, sf):
    n = shred(by_case(spark, [("x", INFOSET)], "doc_id string, xml string"), "doc_id", "xml")
    attrs = F.array_join(F.transform("attrs", lambda a: F.concat_ws("=", a["name"], a["value"])), " ")
    return n.select(F.col("node_id").cast("long").alias("node_id"), F.col("parent_id").cast("long").alias("parent_id"), "name", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("col"), attrs.alias("attrs"), "text")


@cases("case_ string, kind string, document string, expected string", [("set/g/s", "schemaTest", "a.xsd", "valid"), ("set/g/i", "instanceTest", "a.xml", None)])
def suite_catalogue(spark, sf):
    text = '<testSet xmlns:x="http://www.w3.org/1999/xlink"><testGroup name="g"><schemaTest name="s"><schemaDocument x:href="a.xsd"/><expected validity="valid"/></schemaTest><instanceTest name="i" version="1.0"><instanceDocument x:href="a.xml"/><expected validity="invalid"/></instanceTest></testGroup></testSet>'
    return reports.suite_cases(spark, {"set": text}).select(F.col("case").alias("case_"), "kind", "document", "expected")


@cases("case_ string, delta string", [("a", "same"), ("b", "improved"), ("c", "regressed"), ("d", "vanished"), ("e", "removed"), ("f", "new")])
def ratchet_cases(spark, sf):
    before = by_case(spark, [("a", "pass"), ("b", "fail"), ("c", "pass"), ("d", "pass"), ("e", "pass")], "case string, status string")
    now = by_case(spark, [("a", "pass"), ("b", "pass"), ("c", "fail"), ("f", "pass")], "case string, status string")
    return reports.ratchet(before, now, by_case(spark, [("e",)], "case string")).select(F.col("case").alias("case_"), "delta")


@cases("literal string, ok boolean, canonical string", [("ja", True, "JA"), ("nein", True, "NEIN"), ("true", False, None)])
def custom_mapping(spark, sf):
    mine = V.override({"boolean": V.Mapping(canonical=lambda c: F.upper(c))}, {"boolean": V.Mapping(ok=lambda c: c.isin("ja", "nein"))})
    V.CUSTOM.update(mine)
    try:
        v = verdict(F.col("literal"), B["boolean"])
        return by_case(spark, [("ja",), ("nein",), ("true",)], "literal string").select("literal", v["ok"].alias("ok"), v["canonical"].alias("canonical"))
    finally:
        V.CUSTOM.clear()


@cases("a long, b long, c boolean, d string", [(12, None, True, "x y")])
def native_columns(spark, sf):
    one = spark.range(1)
    return one.select(native(F.lit(" 12 "), B["int"]).cast("long").alias("a"), native(F.lit("x"), B["int"]).cast("long").alias("b"), native(F.lit("1"), B["boolean"]).alias("c"), F.array_join(native(F.lit("x  y"), B["NMTOKENS"]), " ").alias("d"))


@cases("name string, type string", [("id", "string"), ("see", "string"), ("line", "array<struct<_n:string,_unit:string,part:int,price:string>>"), ("status", "string")])
def generated_struct(spark, sf):
    text = ORDER.replace('<xs:element name="size" type="sized" minOccurs="0"/><xs:element name="rate" type="xs:decimal" fixed="1.5" minOccurs="0"/><xs:any namespace="urn:skip" processContents="skip" minOccurs="0"/>', "")
    t = schema_to_struct(compile_text(text), ("", "order"))
    return by_case(spark, [(f.name, f.dataType.simpleString()) for f in t.fields], "name string, type string")


@cases("name string, value string", [("row", ""), ("n", "3"), ("s", "a<b&c")])
def xml_encoding(spark, sf):
    made = encode(by_case(spark, [("x", 3, "a<b&c")], "_id string, n int, s string"), "row")
    return shred(made.select(F.lit("d").alias("doc_id"), "xml"), "doc_id", "xml").select("name", F.col("text").alias("value"))
