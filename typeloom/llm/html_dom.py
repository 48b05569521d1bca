"""A small tolerant HTML reader: blocks of text in a tree of block elements.

Inline markup has no node of its own; its text joins the block around it.  The
reader never fails: unclosed and misnested tags close at the next ancestor that
fits, a tag whose quotes do not close ends at the next ">", and text outside any
element belongs to the root.

Time is linear in the page: what was searched in vain (an end tag, the end of a
tag with open quotes, an open element of a name) is never searched again.
"""

from __future__ import annotations

import re
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object textarea title select option canvas audio video".split())
BLOCK = frozenset(
    "html head body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address nav header footer aside form fieldset legend details summary dialog hr hgroup menu search center label button iframe noscript".split()
)
CLOSES_P = BLOCK - frozenset("html head body label button dialog".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol table dl body article section div nav aside main form html header footer".split())

_STOPS = SCOPE.union(SAME, *SAME.values())
_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_MARK = re.compile(r"[>\"']")
#: A character reference with more digits than any code point needs.
_LONG_REFERENCE = re.compile(r"&#(?:[xX]0*([0-9a-fA-F]*)|0*([0-9]*))")
_ATTR = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{2,}")
_KEPT = frozenset(("class", "id", "role", "itemprop", "hidden", "aria-hidden", "aria-label", "style", "data-role"))


class Node:
    """An element (``tag`` is its name) or a block of text (``tag`` is "#text")."""

    __slots__ = ("tag", "tokens", "parent", "depth", "children", "text", "link", "stop")

    def __init__(self, tag: str, tokens: tuple[str, ...], parent: "Node | None"):
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node] = []
        self.text, self.link = "", 0
        #: the next element upwards, itself included, at which a search for one
        #: of the same kind ends or may end
        self.stop: Node | None = self if parent is None or tag in _STOPS else parent.stop
        if parent:
            parent.children.append(self)


def attribute_tokens(raw: str) -> tuple[str, ...]:
    """Lower-case word tokens of the attributes that say what an element is."""
    if not raw or raw.isspace():
        return ()
    out = []
    for name, a, b, c in _ATTR.findall(raw):
        name = name.lower()
        if name in _KEPT:
            value = a or b or c
            if name == "style":
                if "none" in value or "hidden" in value:
                    out.append("hidden")
            elif name in ("hidden", "aria-hidden"):
                if value.lower() != "false":
                    out.append("hidden")
            else:
                out += [w.lower() for w in _WORDS.findall(value)] or ([value.lower()] if value else [])
    return tuple(out)


def _short_reference(m: re.Match) -> str:
    if m[1] is not None:
        return f"&#x{m[1] if len(m[1]) < 9 else 'FFFFFFFF'}"
    return f"&#{(m[2] or '0') if len(m[2]) < 9 else '99999999'}" if m[0] != "&#" else m[0]


def decoded(text: str) -> str:
    """Text with its character references decoded, of however many digits."""
    if "&" not in text:
        return text
    return unescape(_LONG_REFERENCE.sub(_short_reference, text) if "&#" in text else text)


class _Tags:
    """Ends of tags.  ``lost`` holds the quotes from which no end was found."""

    def __init__(self, html: str):
        self.html, self.last, self.lost = html, html.rfind(">"), set()

    def end(self, at: int) -> int:
        """The place of the ">" that ends a tag, from a place inside it; -1 if
        none follows.  A ">" in quotes does not count, unless they stay open."""
        if at > self.last:
            return -1
        html, here, passed = self.html, at, []
        while True:
            m = _MARK.search(html, here)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            if m.start() in self.lost:
                break
            passed.append(m.start())
            close = html.find(m[0], m.end())
            if close < 0:
                break
            here = close + 1
        self.lost.update(passed)
        return html.find(">", at)


def parse(html: str | None) -> Node:
    """The tree of a page; of a null or empty page a root without children."""
    root = Node("#root", (), None)
    if not html:
        return root
    now, held, links, link_at = root, [], 0, 0
    tags, size = _Tags(html), len(html)
    opened: dict[str, int] = {}  # how many elements of a name are open
    missing: set[str] = set()  # what has no end further on

    def flush() -> None:
        nonlocal held, link_at
        if held:
            text = " ".join(decoded("".join(held)).split())
            if text:
                leaf = Node("#text", (), now)
                leaf.text, leaf.link = text, min(link_at, len(text))
            held, link_at = [], 0

    def close(node: Node) -> None:
        """Ends an open element and all that is open inside."""
        nonlocal now
        while now is not node:
            opened[now.tag] -= 1
            now = now.parent
        opened[node.tag] -= 1
        now = node.parent

    def find(what: str, start: int) -> int:
        """The place after the next ``what``, or -1."""
        if what in missing:
            return -1
        found = html.find(what, start)
        if found < 0:
            missing.add(what)
            return -1
        return found + len(what)

    at = 0
    while at < size:
        m = _OPEN.search(html, at)
        start = m.start() if m else size
        if start > at:
            held.append(html[at:start])
            if links:
                link_at += start - at
        if m is None:
            break
        named = _NAME.match(html, start + 1)
        if named is None:
            if html.startswith("<!--", start):
                end = find("-->", start + 4)
            elif html.startswith("<![CDATA[", start):
                end = find("]]>", start + 9)
            else:  # a declaration, or an end tag without a name
                end = find(">", start + 2)
            at = size if end < 0 else end
            continue
        end = tags.end(named.end())
        if end < 0:  # no tag, as nothing ends it
            held.append(html[start:])
            break
        at, name = end + 1, named[1].lower()
        if html[start + 1] == "/":
            if name == "a":
                links = max(0, links - 1)
            elif name in BLOCK:
                flush()
                if opened.get(name):
                    up = now
                    while up.tag != name:
                        up = up.parent
                    close(up)
            elif name == "br":
                held.append(" ")
            continue
        if name in RAW:
            if html[end - 1] == "/":
                continue
            found = None if name in missing else re.compile(rf"</{name}\s*>", re.I).search(html, at)
            if found:
                at = found.end()
            else:
                missing.add(name)
                if name in ("script", "style", "textarea", "title"):
                    at = size
            continue
        if name in BLOCK:
            flush()
            links = 0
            if name in CLOSES_P and now.tag == "p":
                close(now)
            same = SAME.get(name)
            if same:
                up = now.stop
                while up is not root and up.tag not in same and up.tag not in SCOPE:
                    up = up.parent.stop
                if up.tag in same:
                    close(up)
            if name in VOID:
                continue
            now = Node(name, attribute_tokens(html[named.end() : end]), now)
            opened[name] = opened.get(name, 0) + 1
        elif name == "a":
            links += 1
        elif name in VOID:
            held.append(" ")
    flush()
    return root
