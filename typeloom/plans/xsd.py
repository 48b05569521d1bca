"""Schema documents into components: composition, then production.

The closure of a document over include, import, override and redefine is loaded
first, each reading once; names are indexed; components are built on demand, so
order of declaration does not matter; then the model is checked.  The first
error ends a compilation.
"""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from urllib.parse import urljoin

from ..functions.patterns import PatternError, translate
from ..functions.types import ANY_SIMPLE, APPLICABLE, KINDS, XSD, Facet, SimpleType
from ..functions.values import order_of, white_text
from ..sources.xml_reader import Element, XmlError, read
from .grammar import gate
from .model import ANY_TYPE, Alternative, Attribute, ComplexType, Constraint, ElementDecl, Group, Particle, QName, Schema, SchemaError, XPath
from .namespaces import Occurs, Wildcard, intersect, subset, union
from .namespaces import parse as parse_namespace

XSI_NS = "http://www.w3.org/2001/XMLSchema-instance"
Resolver = Callable[[str], bytes | None]


def memory(documents: dict[str, str | bytes]) -> Resolver:
    """Documents held in memory, by location."""
    return lambda at: (d.encode() if isinstance(d := documents[at], str) else d) if at in documents else None


def directory(root: str) -> Resolver:
    """Files below a folder; a location that leaves it is not found."""

    def find(at: str) -> bytes | None:
        path = os.path.realpath(os.path.join(root, at))
        if not path.startswith(os.path.realpath(root) + os.sep) or not os.path.isfile(path):
            return None
        with open(path, "rb") as f:
            return f.read()

    return find


def chain(*resolvers: Resolver) -> Resolver:
    """The first resolver that finds a location wins."""

    def find(at: str) -> bytes | None:
        for r in resolvers:
            found = r(at)
            if found is not None:
                return found
        return None

    return find


LOG = logging.getLogger("typeloom")
_KIND_OF = {"simpleType": "type", "complexType": "type", "element": "element", "attribute": "attribute", "group": "group", "attributeGroup": "attributeGroup", "notation": "notation"}
_FACETS = frozenset(KINDS) - {"assertions"}


class Compiler:
    """One compilation.  ``raw`` maps (kind, name) to (element, document)."""

    def __init__(self, resolver: Resolver):
        self.resolver = resolver
        self.schema = Schema()
        self.raw: dict[tuple[str, QName], tuple[Element, "Document"]] = {}
        self.loaded: set[tuple] = set()
        self.building: set[tuple[str, QName]] = set()
        self.hidden: dict[tuple[str, QName], tuple[Element, Document]] = {}
        self.originals: dict[tuple[str, QName], object] = {}
        self.documents: list[Document] = []

    # composition ---------------------------------------------------------

    def load(self, at: str, namespace: str | None = None, chameleon: bool = False, overrides: dict | None = None, redefines: dict | None = None, required: bool = True, root: bool = False) -> None:
        ident = (at, namespace if chameleon else None, id(overrides) if overrides else None, id(redefines) if redefines else None)
        if ident in self.loaded:
            return
        data = self.resolver(at)
        if data is None:
            if required:
                raise SchemaError("src-resolve" if root else "src-redefine", f"{at} cannot be read", (at, 0, 0))
            self.schema.report.append((at, "document", "not found"))
            LOG.info("%s is not found, and not needed", at)
            return
        self.loaded.add(ident)
        try:
            top = read(data)
        except XmlError as e:
            raise SchemaError("xml-wf", e.message, (at, e.line, e.column)) from None
        if (top.ns, top.local) != (XSD, "schema"):
            raise SchemaError("", f"{at}: the root is no schema", (at, top.line, top.column))
        own = top.get("targetNamespace")
        if own == "":
            raise SchemaError("", f"{at}: an empty targetNamespace", (at, top.line, top.column))
        doc = Document(at, top, own if own is not None else "")
        gate(top, lambda message, e: SchemaError("", message, doc.where(e)))
        if namespace is not None:
            if own is None and chameleon and namespace:
                doc.namespace, doc.chameleon = namespace, True
            elif (own or "") != namespace:
                raise SchemaError("src-include" if chameleon else "src-import", f"{at} has target namespace {own!r}, not {namespace!r}", (at, top.line, top.column))
        self.documents.append(doc)
        self.schema.report.append((at, "document", "used"))
        LOG.debug("%s is read, with target namespace %r", at, doc.namespace)
        for e in top.elements():
            if e.ns != XSD:
                raise SchemaError("", f"{e.local} is no schema element", doc.where(e))
            target = e.get("schemaLocation")
            location = urljoin(at, target) if target else None
            if e.local == "include":
                if not location:
                    raise SchemaError("", "an include without schemaLocation", doc.where(e))
                self.load(location, doc.namespace, True, overrides, None, required=False)
            elif e.local == "import":
                ns = e.get("namespace")
                if ns == doc.namespace or (ns is None and not doc.namespace):
                    raise SchemaError("src-import", "a schema cannot import its own namespace", doc.where(e))
                doc.imports.add(ns or "")
                if location:
                    self.load(location, ns or "", False, required=False)
                else:
                    self.schema.report.append((at, f"import {ns}", "no location"))
            elif e.local in ("override", "redefine"):
                changed: dict[tuple[str, QName], tuple[Element, Document]] = {}
                for c in e.elements():
                    if c.local == "annotation":
                        continue
                    k = (_KIND_OF.get(c.local, c.local), (doc.namespace, c.get("name") or ""))
                    if k in changed:
                        raise SchemaError(f"src-{e.local}", f"{k[1][1]} twice", doc.where(c))
                    if e.local == "redefine":
                        _redefines_itself(c, doc)
                    changed[k] = (c, doc)
                if not location:
                    raise SchemaError("", f"{e.local} without schemaLocation", doc.where(e))
                if e.local == "override":
                    merged = changed | (overrides or {})
                    self.load(location, doc.namespace, True, merged, None, required=False)
                else:
                    self.load(location, doc.namespace, True, overrides, changed, required=bool(changed))
                    for k, v in changed.items():
                        if k not in self.hidden:
                            raise SchemaError("src-redefine", f"nothing to redefine as {k[1][1]}", doc.where(v[0]))
                        self.raw[k] = v
        for e in top.elements():
            if e.local in _KIND_OF:
                name = e.get("name")
                if not name:
                    raise SchemaError("", f"a global {e.local} without name", doc.where(e))
                k = (_KIND_OF[e.local], (doc.namespace, name))
                if redefines and k in redefines:
                    self.hidden[k] = (e, doc)
                    continue
                if overrides and k in overrides:
                    new, from_ = overrides[k]
                    self.raw[k] = (new, Document(from_.at, from_.top, doc.namespace, from_.imports, doc.chameleon))
                    continue
                if k in self.raw and self.raw[k][0] is not e:
                    raise SchemaError("sch-props-correct", f"{e.local} {name} twice", doc.where(e))
                self.raw[k] = (e, doc)
            elif e.local not in ("annotation", "include", "import", "override", "redefine", "defaultOpenContent"):
                raise SchemaError("", f"{e.local} cannot stand here", doc.where(e))

    # references ----------------------------------------------------------

    def name_of(self, text: str, e: Element, doc: "Document") -> QName:
        found = e.resolve(text)
        if found is None:
            raise SchemaError("src-resolve", f"the prefix of {text} is not bound", doc.where(e))
        if found[0] == "" and doc.chameleon:
            found = (doc.namespace, found[1])
        if found[0] not in (doc.namespace, XSD, XSI_NS) and found[0] not in doc.imports:
            raise SchemaError("src-resolve", f"{text}: its namespace is not imported", doc.where(e))
        return found

    def find(self, kind: str, name: QName, e: Element, doc: "Document"):
        store = {"type": self.schema.types, "element": self.schema.elements, "attribute": self.schema.attributes, "group": self.schema.groups, "attributeGroup": self.schema.attribute_groups}[kind]
        if name in store:
            return store[name]
        k = (kind, name)
        if k not in self.raw:
            raise SchemaError("src-resolve", f"no {kind} {name[1]}", doc.where(e))
        if k in self.building and k in self.hidden and kind in ("group", "attributeGroup"):
            return self.redefined(kind, name)
        if k in self.building:
            simple = "cos-st-restricts" if self.raw[k][0].elements("union") else "st-props-correct"
            rule = {"type": simple if self.raw[k][0].local == "simpleType" else "ct-props-correct", "group": "mg-props-correct"}.get(kind, "src-resolve")
            raise SchemaError(rule, f"{name[1]} is defined by itself", doc.where(e))
        self.building.add(k)
        try:
            el, owner = self.raw[k]
            hidden = self.hidden.get(k)
            original = None
            if hidden and kind == "type":
                original = self.any_type_of(hidden[0], hidden[1], name)
            if kind == "type":
                store[name] = self.any_type_of(el, owner, name, original)
            elif kind == "element":
                self.global_element(el, owner, name)
            elif kind == "attribute":
                store[name] = self.attribute(el, owner, name)
            elif kind == "group":
                store[name] = self.group_definition(el, owner, name)
            else:
                store[name] = self.attribute_uses(el, owner)
        finally:
            self.building.discard(k)
        return store[name]

    def redefined(self, kind: str, name: QName):
        """The group that a redefinition replaces: what it means by its own name."""
        k = (kind, name)
        if k not in self.originals:
            el, owner = self.hidden[k]
            self.originals[k] = self.group_definition(el, owner, name) if kind == "group" else self.attribute_uses(el, owner)
        return self.originals[k]

    def check_redefinitions(self) -> None:
        """A redefined group without its own name in it only restricts the old one."""
        from .content import Declined, automaton, included

        for (kind, name), _ in self.hidden.items():
            k = (kind, name)
            if kind not in ("group", "attributeGroup") or k in self.originals:
                continue
            at = self.raw[k][1].where(self.raw[k][0])
            if kind == "group":
                whole = lambda g: ComplexType(name, variety="element-only", particle=Particle(Occurs(), g))
                try:
                    inside = included(automaton(whole(self.schema.groups[name]), self.schema), automaton(whole(self.redefined(kind, name)), self.schema))
                except Declined as why:
                    LOG.info("no verdict on the redefinition of group %s: %s", name[1], why)
                    continue
                why = None if inside else "it admits more than the group it redefines"
            else:
                why = self.widens(*self.schema.attribute_groups[name], *self.redefined(kind, name))
            if why:
                raise SchemaError("src-redefine", f"{name[1]}: {why}", at)

    # simple types --------------------------------------------------------

    def any_type_of(self, e: Element, doc: "Document", name: QName | None, original=None):
        if e.local == "simpleType":
            return self.simple(e, doc, name, original)
        return self.complex(e, doc, name, original)

    def simple_ref(self, text: str, e: Element, doc: "Document") -> SimpleType:
        t = self.find("type", self.name_of(text, e, doc), e, doc)
        if not isinstance(t, SimpleType):
            raise SchemaError("src-resolve", f"{text} is no simple type", doc.where(e))
        return t

    def simple(self, e: Element, doc: "Document", name: QName | None, original=None) -> SimpleType:
        label = None if name is None else (f"{{{name[0]}}}{name[1]}" if name[0] else name[1])
        way = next(iter(e.elements("restriction", "list", "union")), None)
        if way is None:
            raise SchemaError("", "a simpleType without content", doc.where(e))
        final = frozenset((e.get("final") or doc.top.get("finalDefault") or "").replace("#all", "restriction list union extension").split())
        inline = way.elements("simpleType")
        if way.local == "restriction":
            if bool(way.get("base")) == bool(inline):
                raise SchemaError("src-restriction-base-or-simpleType", "base or simpleType, one of them", doc.where(way))
            if original is not None and self.name_of(way.get("base"), way, doc) == name:
                base = original
            else:
                base = self.simple_ref(way.get("base"), way, doc) if way.get("base") else self.simple(inline[0], doc, None)
            if "restriction" in base.final:
                raise SchemaError("st-props-correct", f"{base.name} is final", doc.where(way))
            if base.name == "anySimpleType":
                raise SchemaError("st-props-correct", "anySimpleType cannot be restricted", doc.where(way))
            facets = self.facets(way, doc, base)
            return SimpleType(label, base, base.variety, base.item, base.members, facets, final, tuple(sorted((k, v) for k, v in way.bindings.items())))
        if way.local == "list":
            if bool(way.get("itemType")) == bool(inline):
                raise SchemaError("src-list-itemType-or-simpleType", "itemType or simpleType, one of them", doc.where(way))
            item = self.simple_ref(way.get("itemType"), way, doc) if way.get("itemType") else self.simple(inline[0], doc, None)
            if item.variety == "list" or (item.variety == "union" and any(m.variety == "list" for m in item.members)):
                raise SchemaError("cos-st-restricts", "a list of lists", doc.where(way))
            if "list" in item.final:
                raise SchemaError("st-props-correct", f"{item.name} is final for lists", doc.where(way))
            return SimpleType(label, ANY_SIMPLE, "list", item=item, facets=(Facet("whiteSpace", ("collapse",), True),), final=final)
        names = (way.get("memberTypes") or "").split()
        if not names and not inline:
            raise SchemaError("src-union-memberTypes-or-simpleTypes", "a union of nothing", doc.where(way))
        members = tuple([self.simple_ref(n, way, doc) for n in names] + [self.simple(i, doc, None) for i in inline])
        if any("union" in m.final for m in members):
            raise SchemaError("st-props-correct", "a member is final for unions", doc.where(way))
        return SimpleType(label, ANY_SIMPLE, "union", members=members, final=final)

    def facets(self, way: Element, doc: "Document", base: SimpleType) -> tuple[Facet, ...]:
        found: dict[str, tuple[list[str], bool, Element]] = {}
        for f in way.elements():
            if f.local not in _FACETS:
                continue
            v = f.get("value")
            if v is None:
                raise SchemaError("", f"{f.local} without value", doc.where(f))
            if f.local in found and f.local not in ("pattern", "enumeration"):
                raise SchemaError("", f"{f.local} twice", doc.where(f))
            found.setdefault(f.local, ([], f.get("fixed") in ("true", "1"), f))[0].append(v)
        out = tuple(Facet(k, tuple(v), fixed) for k, (v, fixed, _) in found.items())
        check_facets(base, out, lambda k: doc.where(found[k][2]))
        return out

    # attributes ----------------------------------------------------------

    def attribute(self, e: Element, doc: "Document", name: QName) -> Attribute:
        if e.get("default") is not None and e.get("fixed") is not None:
            raise SchemaError("src-attribute", "default and fixed", doc.where(e))
        inline = e.elements("simpleType")
        if e.get("type") and inline:
            raise SchemaError("src-attribute", "type and simpleType", doc.where(e))
        t = self.simple_ref(e.get("type"), e, doc) if e.get("type") else (self.simple(inline[0], doc, None) if inline else ANY_SIMPLE)
        use = e.get("use") or "optional"
        if e.get("default") is not None and use not in ("optional",):
            raise SchemaError("src-attribute", "a default on an attribute that is not optional", doc.where(e))
        if name == ("", "xmlns") or name[0] == XSI_NS:
            raise SchemaError("a-props-correct", f"{name[1]} cannot be declared", doc.where(e))
        return Attribute(name, t, e.get("default"), e.get("fixed"), use == "required", use == "prohibited", e.get("inheritable") in ("true", "1"))

    def attribute_uses(self, e: Element, doc: "Document") -> tuple[dict[QName, Attribute], Wildcard | None]:
        uses: dict[QName, Attribute] = {}
        wild: Wildcard | None = None
        for c in e.elements("attribute", "attributeGroup", "anyAttribute"):
            if c.local == "attribute":
                if c.get("ref"):
                    name = self.name_of(c.get("ref"), c, doc)
                    decl = self.find("attribute", name, c, doc)
                    use = c.get("use") or "optional"
                    a = Attribute(name, decl.type, c.get("default") or decl.default, c.get("fixed") or decl.fixed, use == "required", use == "prohibited", decl.inheritable)
                else:
                    form = c.get("form") or doc.top.get("attributeFormDefault") or "unqualified"
                    a = self.attribute(c, doc, (doc.namespace if form == "qualified" else "", c.get("name") or ""))
                if a.name in uses:
                    raise SchemaError("ct-props-correct" if e.local != "attributeGroup" else "ag-props-correct", f"attribute {a.name[1]} twice", doc.where(c))
                uses[a.name] = a
            elif c.local == "attributeGroup":
                name = self.name_of(c.get("ref") or "", c, doc)
                if ("attributeGroup", name) in self.building and ("attributeGroup", name) not in self.hidden:
                    continue  # a circular group adds nothing
                more, w = self.find("attributeGroup", name, c, doc)
                for n, a in more.items():
                    if n in uses:
                        raise SchemaError("ct-props-correct", f"attribute {n[1]} twice", doc.where(c))
                    uses[n] = a
                if w:
                    wild = w if wild is None else Wildcard(intersect(wild.constraint, w.constraint), wild.process, wild.disallowed | w.disallowed, wild.defined or w.defined)
            else:
                w = self.wildcard(c, doc)
                wild = w if wild is None else Wildcard(intersect(w.constraint, wild.constraint), w.process, wild.disallowed | w.disallowed, wild.defined or w.defined)
        return uses, wild

    def wildcard(self, e: Element, doc: "Document") -> Wildcard:
        if e.get("namespace") is not None and e.get("notNamespace") is not None:
            raise SchemaError("src-wildcard", "namespace and notNamespace", doc.where(e))
        names = (e.get("notQName") or "").split()
        plain = frozenset(self.plain(n, e, doc) for n in names if not n.startswith("##"))
        return Wildcard(parse_namespace(e.get("namespace"), e.get("notNamespace"), doc.namespace), e.get("processContents") or "strict", plain, "##defined" in names, "##definedSibling" in names)

    def plain(self, text: str, e: Element, doc: "Document") -> QName:
        found = e.resolve(text)
        if found is None:
            raise SchemaError("src-resolve", f"the prefix of {text} is not bound", doc.where(e))
        return found

    # particles -----------------------------------------------------------

    def occurs(self, e: Element, doc: "Document") -> Occurs:
        low, high = e.get("minOccurs", "1"), e.get("maxOccurs", "1")
        try:
            o = Occurs(int(low), None if high == "unbounded" else int(high))
        except ValueError:
            raise SchemaError("", "a malformed occurrence", doc.where(e)) from None
        if o.high is not None and o.low > o.high:
            raise SchemaError("p-props-correct", "minOccurs over maxOccurs", doc.where(e))
        return o

    def particle(self, e: Element, doc: "Document") -> Particle | None:
        o = self.occurs(e, doc)
        if o.high == 0:
            return None
        if e.local == "element":
            if e.get("ref"):
                return Particle(o, self.find("element", self.name_of(e.get("ref"), e, doc), e, doc))
            form = e.get("form") or doc.top.get("elementFormDefault") or "unqualified"
            return Particle(o, self.element(e, doc, (doc.namespace if form == "qualified" else "", e.get("name") or "")))
        if e.local == "any":
            return Particle(o, self.wildcard(e, doc))
        if e.local == "group":
            g = self.find("group", self.name_of(e.get("ref") or "", e, doc), e, doc)
            if g.compositor == "all" and o != Occurs():
                if o.high != 1:
                    raise SchemaError("cos-all-limited", "an all group that repeats", doc.where(e))
            return Particle(o, g)
        return Particle(o, self.group(e, doc))

    def group(self, e: Element, doc: "Document") -> Group:
        parts = [p for c in e.elements("element", "any", "group", "sequence", "choice", "all") if (p := self.particle(c, doc))]
        if e.local == "all":
            for p in parts:
                if isinstance(p.term, Group) and not (p.term.compositor == "all" and p.occurs == Occurs()):
                    raise SchemaError("cos-all-limited", "a group inside an all group", doc.where(e))
        else:
            for p in parts:
                if isinstance(p.term, Group) and p.term.compositor == "all":
                    raise SchemaError("cos-all-limited", "an all group inside another group", doc.where(e))
        return Group(e.local, parts)

    def group_definition(self, e: Element, doc: "Document", name: QName) -> Group:
        inner = e.elements("sequence", "choice", "all")
        if not inner:
            raise SchemaError("", "a group without content", doc.where(e))
        g = self.group(inner[0], doc)
        g.name = name
        return g

    # elements ------------------------------------------------------------

    def global_element(self, e: Element, doc: "Document", name: QName) -> ElementDecl:
        d = ElementDecl(name, is_global=True, where=doc.where(e))
        self.schema.elements[name] = d  # before its type: a type may hold the element
        self.fill(d, e, doc)
        return d

    def element(self, e: Element, doc: "Document", name: QName) -> ElementDecl:
        d = ElementDecl(name, where=doc.where(e))
        self.fill(d, e, doc)
        return d

    def fill(self, d: ElementDecl, e: Element, doc: "Document") -> None:
        if e.get("default") is not None and e.get("fixed") is not None:
            raise SchemaError("src-element", "default and fixed", doc.where(e))
        inline = e.elements("simpleType", "complexType")
        if e.get("type") and inline:
            raise SchemaError("src-element", "type and an anonymous type", doc.where(e))
        d.nillable, d.abstract = e.get("nillable") in ("true", "1"), e.get("abstract") in ("true", "1")
        d.default, d.fixed = e.get("default"), e.get("fixed")
        every = "extension restriction substitution"
        d.block = frozenset((e.get("block") if e.get("block") is not None else doc.top.get("blockDefault") or "").replace("#all", every).split())
        d.final = frozenset((e.get("final") if e.get("final") is not None else doc.top.get("finalDefault") or "").replace("#all", "extension restriction").split())
        d.heads = [self.name_of(h, e, doc) for h in (e.get("substitutionGroup") or "").split()]
        if inline:
            d.type = self.any_type_of(inline[0], doc, None)
        elif e.get("type"):
            name = self.name_of(e.get("type"), e, doc)
            if ("type", name) in self.building:
                self.later.append((d, name))
                d.type = None
            else:
                d.type = self.find("type", name, e, doc)
        elif d.heads and ("element", d.heads[0]) in self.raw | {("element", n): 0 for n in self.schema.elements}:
            d.type = self.find("element", d.heads[0], e, doc).type
        else:
            d.type = ANY_TYPE
        for alt in e.elements("alternative"):
            t = self.find("type", self.name_of(alt.get("type"), alt, doc), alt, doc) if alt.get("type") else self.any_type_of(alt.elements("simpleType", "complexType")[0], doc, None)
            d.alternatives.append(Alternative(self.xpath(alt, "test", doc) if alt.get("test") is not None else None, t))
        for c in e.elements("key", "unique", "keyref"):
            name = (doc.namespace, c.get("name") or "")
            if name in self.schema.constraints:
                raise SchemaError("sch-props-correct", f"identity constraint {name[1]} twice", doc.where(c))
            selector = c.elements("selector")
            if not selector:
                raise SchemaError("", f"{c.local} without selector", doc.where(c))
            made = Constraint(c.local, name, self.xpath(selector[0], "xpath", doc), [self.xpath(f, "xpath", doc) for f in c.elements("field")], self.name_of(c.get("refer"), c, doc) if c.get("refer") else None)
            self.schema.constraints[name] = made
            d.constraints.append(made)

    def xpath(self, e: Element, attr: str, doc: "Document") -> XPath:
        default = e.get("xpathDefaultNamespace") or doc.top.get("xpathDefaultNamespace") or "##local"
        ns = {"##local": "", "##targetNamespace": doc.namespace, "##defaultNamespace": e.bindings.get("", "")}.get(default, default)
        return XPath(e.get(attr) or "", dict(e.bindings), ns)

    # complex types -------------------------------------------------------

    def complex(self, e: Element, doc: "Document", name: QName | None, original=None) -> ComplexType:
        t = ComplexType(name, where=doc.where(e))
        if name is not None and original is None:
            self.schema.types[name] = t  # before its content: it may hold itself
        t.abstract = e.get("abstract") in ("true", "1")
        every = "extension restriction"
        t.block = frozenset((e.get("block") if e.get("block") is not None else doc.top.get("blockDefault") or "").replace("#all", every).split()) & {"extension", "restriction"}
        t.final = frozenset((e.get("final") if e.get("final") is not None else doc.top.get("finalDefault") or "").replace("#all", every).split())
        content = next(iter(e.elements("simpleContent", "complexContent")), None)
        way = next(iter(content.elements("restriction", "extension")), None) if content is not None else None
        if content is not None and way is None:
            raise SchemaError("", "content without a derivation", doc.where(e))
        body = way if way is not None else e
        base: object = ANY_TYPE
        if way is not None:
            base_name = self.name_of(way.get("base") or "", way, doc)
            base = original if original is not None and base_name == name else self.find("type", base_name, way, doc)
            t.derivation = way.local
        if base is t:
            raise SchemaError("ct-props-correct", f"{name and name[1]} is its own base", doc.where(e))
        t.base = base
        if isinstance(base, (ComplexType, SimpleType)) and way is not None and way.local in base.final:
            raise SchemaError("cos-ct-extends" if way.local == "extension" else "derivation-ok-restriction", "the base is final for this derivation", doc.where(e))
        t.assertions = (list(base.assertions) if isinstance(base, ComplexType) else []) + [self.xpath(a, "test", doc) for a in body.elements("assert")]
        uses, wild = self.attribute_uses(body, doc)
        if content is not None and content.local == "simpleContent":
            t.variety = "simple"
            if isinstance(base, SimpleType):
                if way.local != "extension":
                    raise SchemaError("src-ct", "a simple type can only be extended", doc.where(way))
                t.simple = base
            elif base.variety == "simple":
                t.simple = base.simple
                if way.local == "restriction":
                    inline = way.elements("simpleType")
                    under = self.simple(inline[0], doc, None) if inline else base.simple
                    facets = self.facets(way, doc, under)
                    t.simple = SimpleType(None, under, under.variety, under.item, under.members, facets) if facets else under
            elif base.variety == "mixed" and way.local == "restriction" and way.elements("simpleType"):
                t.simple = self.simple(way.elements("simpleType")[0], doc, None)
            else:
                raise SchemaError("src-ct", "simpleContent of a base without it", doc.where(way))
        else:
            if isinstance(base, SimpleType):
                raise SchemaError("src-ct", "complexContent of a simple type", doc.where(way))
            mixed = (content.get("mixed") if content is not None and content.get("mixed") is not None else e.get("mixed")) in ("true", "1")
            inner = body.elements("sequence", "choice", "all", "group")
            p = self.particle(inner[0], doc) if inner else None
            if p is not None and isinstance(p.term, Group) and not p.term.particles and (p.term.compositor != "choice" or p.occurs.low == 0):
                p = None if not mixed else p
            if way is not None and way.local == "extension" and isinstance(base, ComplexType):
                bp = base.particle
                if bp is not None and p is not None:
                    if isinstance(bp.term, Group) and isinstance(p.term, Group) and bp.term.compositor == p.term.compositor == "all":
                        p = Particle(Occurs(min(bp.occurs.low, p.occurs.low), 1), Group("all", bp.term.particles + p.term.particles))
                    else:
                        if any(isinstance(x.term, Group) and x.term.compositor == "all" for x in (bp, p)):
                            raise SchemaError("cos-all-limited", "an all group inside a sequence", doc.where(e))
                        p = Particle(Occurs(), Group("sequence", [bp, p]))
                else:
                    p = p or bp
                if base.variety in ("mixed", "element-only") and inner and (base.variety == "mixed") != mixed and base is not ANY_TYPE:
                    raise SchemaError("cos-ct-extends", "mixed and element-only", doc.where(e))
                mixed = mixed or (base.variety == "mixed" and not inner)
            t.particle = p
            t.variety = "mixed" if mixed else ("element-only" if p is not None else "empty")
            oc = next(iter(body.elements("openContent")), None)
            default = next(iter(doc.top.elements("defaultOpenContent")), None)
            if oc is None and default is not None and (t.variety != "empty" or default.get("appliesToEmpty") in ("true", "1")):
                oc = default
            if oc is not None and (oc.get("mode") or "interleave") != "none" and oc.elements("any"):
                t.open_content = (oc.get("mode") or "interleave", self.wildcard(oc.elements("any")[0], doc))
            elif isinstance(base, ComplexType) and t.derivation == "extension":
                t.open_content = base.open_content
        self.fold_attributes(t, base, uses, wild, doc, e)
        return t

    def widens(self, uses: dict, wild: Wildcard | None, old: dict, before: Wildcard | None) -> str | None:
        """What attribute uses admit that the old ones do not; None for nothing."""
        for n, a in uses.items():
            b = old.get(n)
            if a.prohibited:
                if b is not None and b.required:
                    return f"attribute {n[1]} was required"
            elif b is None:
                if before is None or not before.admits(n):
                    return f"attribute {n[1]} is not in the base"
            elif b.required and not a.required:
                return f"attribute {n[1]} was required"
            elif self.schema.derivation(a.type, b.type) is None:
                return f"the type of attribute {n[1]} is not derived"
            elif b.fixed is not None and a.fixed != b.fixed:
                return f"attribute {n[1]} was fixed"
        if wild is not None and (before is None or not subset(wild.constraint, before.constraint)):
            return "the attribute wildcard admits more than the base's"
        return None

    def fold_attributes(self, t: ComplexType, base, uses: dict, wild: Wildcard | None, doc: "Document", e: Element) -> None:
        old = base.attributes if isinstance(base, ComplexType) else {}
        before = base.wildcard if isinstance(base, ComplexType) else None
        t.attributes = {n: a for n, a in uses.items() if not a.prohibited}
        if t.derivation == "extension":
            for n in set(old) & set(t.attributes):
                raise SchemaError("ct-props-correct", f"attribute {n[1]} twice", doc.where(e))
            t.wildcard = wild if before is None else (before if wild is None else Wildcard(union(wild.constraint, before.constraint), wild.process, wild.disallowed & before.disallowed, wild.defined and before.defined))
        else:
            if base is not ANY_TYPE and isinstance(base, ComplexType):
                why = self.widens(uses, wild, old, before)
                if why:
                    raise SchemaError("derivation-ok-restriction", why, doc.where(e))
            t.wildcard = wild
        for n, a in old.items():
            if n not in t.attributes and not (t.derivation == "restriction" and n in uses):
                t.attributes[n] = a

    # all of it -----------------------------------------------------------

    def compile(self, at: str) -> Schema:
        self.later: list[tuple[ElementDecl, QName]] = []
        self.load(at, root=True)
        for (kind, name), (e, doc) in list(self.raw.items()):
            if kind == "notation":
                if e.get("public") is None and e.get("system") is None:
                    raise SchemaError("src-notation", "a notation needs public or system", doc.where(e))
                self.schema.notations[name] = (e.get("public"), e.get("system"))
            else:
                self.find(kind, name, e, doc)
        for d, name in self.later:
            d.type = self.schema.types[name]
        self.check_redefinitions()
        from .checks import check

        check(self.schema)
        return self.schema


class Document:
    def __init__(self, at: str, top: Element, namespace: str, imports: set[str] | None = None, chameleon: bool = False):
        self.at, self.top, self.namespace, self.imports, self.chameleon = at, top, namespace, imports if imports is not None else set(), chameleon

    def where(self, e: Element) -> tuple[str, int, int]:
        return self.at, e.line, e.column


def _redefines_itself(e: Element, doc: Document) -> None:
    """A redefined type derives from itself; a group names itself once at most."""
    name = e.get("name") or ""
    own = lambda text: (found := e.resolve(text)) is not None and found[1] == name and found[0] in (doc.namespace, "")
    if e.local in ("simpleType", "complexType"):
        ways = [w for c in ([e] if e.local == "simpleType" else e.elements("simpleContent", "complexContent")) for w in c.elements("restriction", "extension")]
        if len(ways) != 1 or not own(ways[0].get("base") or ""):
            raise SchemaError("src-redefine", f"{name} does not derive from itself", doc.where(e))
        return
    todo, found = e.elements(), 0
    while todo:
        c = todo.pop()
        todo += c.elements()
        if c.local == e.local and c.get("ref") and own(c.get("ref")):
            found += 1
            if e.local == "group" and (c.get("minOccurs", "1"), c.get("maxOccurs", "1")) != ("1", "1"):
                raise SchemaError("src-redefine", f"{name} repeats itself", doc.where(c))
    if found > 1:
        raise SchemaError("src-redefine", f"{name} names itself {found} times", doc.where(e))


BOUNDS = ("minInclusive", "minExclusive", "maxInclusive", "maxExclusive")


def check_facets(base: SimpleType, facets: tuple[Facet, ...], where: Callable[[str], tuple]) -> None:
    """Applicability, well-formed values, and that every step only narrows."""
    from decimal import Decimal

    kind = base.variety if base.variety != "atomic" else base.primitive()
    allowed = APPLICABLE.get(kind, APPLICABLE.get({"yearMonthDuration": "duration", "dayTimeDuration": "duration", "dateTimeStamp": "dateTime"}.get(kind, ""), frozenset()))
    old = {f.kind: f for f, _ in base.effective()}
    new = {f.kind: f for f in facets}
    for k, f in new.items():
        if k not in allowed:
            raise SchemaError("cos-applicable-facets", f"{k} does not apply", where(k))
        if k in old and old[k].fixed and old[k].values != f.values:
            raise SchemaError(f"{'timezone' if k == 'explicitTimezone' else k}-valid-restriction", f"{k} is fixed", where(k))
        if k == "pattern":
            for p in f.values:
                try:
                    translate(p)
                except PatternError as e:
                    raise SchemaError("src-pattern-value", str(e), where(k)) from None
        if k in ("length", "minLength", "maxLength", "totalDigits", "fractionDigits", "maxScale", "minScale"):
            try:
                n = int(f.values[0])
            except ValueError:
                raise SchemaError("", f"{k} is no number", where(k)) from None
            o = int(old[k].values[0]) if k in old else None
            if o is not None and ((k == "length" and n != o) or (k in ("minLength", "minScale") and n < o) or (k in ("maxLength", "totalDigits", "fractionDigits", "maxScale") and n > o)):
                raise SchemaError(f"{k}-valid-restriction", f"{k} {n} widens {o}", where(k))
        if k == "whiteSpace" and k in old and ["preserve", "replace", "collapse"].index(f.values[0]) < ["preserve", "replace", "collapse"].index(old[k].values[0]):
            raise SchemaError("whiteSpace-valid-restriction", "whiteSpace widens", where(k))
        if k == "explicitTimezone" and k in old and old[k].values[0] != "optional" and old[k].values[0] != f.values[0]:
            raise SchemaError("timezone-valid-restriction", "explicitTimezone changes", where(k))
    every = old | new
    get = lambda k: int(every[k].values[0]) if k in every else None
    if get("minLength") is not None and get("maxLength") is not None and get("minLength") > get("maxLength"):
        raise SchemaError("minLength-less-than-equal-to-maxLength", "minLength over maxLength", where(next(iter(new))))
    if get("fractionDigits") is not None and get("totalDigits") is not None and get("fractionDigits") > get("totalDigits") and "totalDigits" in every:
        raise SchemaError("fractionDigits-totalDigits", "fractionDigits over totalDigits", where(next(iter(new))))
    if base.variety == "atomic" and kind not in ("QName", "NOTATION"):
        _check_values(base, kind, new, old, where)
    if "minInclusive" in new and "minExclusive" in new or "maxInclusive" in new and "maxExclusive" in new:
        raise SchemaError("st-props-correct", "an inclusive and an exclusive bound", where(next(iter(new))))


def _check_values(base: SimpleType, kind: str, new: dict[str, Facet], old: dict[str, Facet], where: Callable[[str], tuple]) -> None:
    """Values of facets are values of the base, and bounds only narrow."""
    from .literals import check_literal

    for v in new["enumeration"].values if "enumeration" in new else ():
        if check_literal(v, base) is not None:
            raise SchemaError("enumeration-valid-restriction", f"{v} is no value of the base", where("enumeration"))
    text = lambda f: white_text(f.values[0], "collapse")
    for k in BOUNDS:
        if k in new:
            try:
                order_of(text(new[k]), text(new[k]), kind)
            except (ValueError, ArithmeticError):
                raise SchemaError(f"{k}-valid-restriction", f"{text(new[k])} is no {kind}", where(k)) from None
    for k in BOUNDS:
        if k in new and k in old:
            way = order_of(text(new[k]), text(old[k]), kind)
            if way is None or (k.startswith("min") and way < 0) or (k.startswith("max") and way > 0):
                raise SchemaError(f"{k}-valid-restriction", f"{text(new[k])} widens {text(old[k])}", where(k))
    every = old | new
    for a in ("minInclusive", "minExclusive"):
        for b in ("maxInclusive", "maxExclusive"):
            # what the base has alone was judged there
            if a in every and b in every and (a in new or b in new) and order_of(text(every[a]), text(every[b]), kind) == 1:
                k = a if a in new else b
                raise SchemaError(f"{k}-valid-restriction", "no value is left", where(k))


def compile_schema(location: str, resolver: Resolver) -> Schema:
    """The schema of a document and all it brings in, checked."""
    return Compiler(resolver).compile(location)


def compile_text(text: str, **more: str) -> Schema:
    """The schema of one document given as text; others by location."""
    return compile_schema("schema.xsd", memory({"schema.xsd": text} | more))
