"""Content models: automata over child names, and their use on columns.

A particle becomes a position automaton; of the positions a name can reach,
element declarations come before wildcards.  The automaton becomes one map from
(state, name) to the next state, and a sequence of children is a fold over it:
where it stops is the first child that is not admitted, and where it ends tells
whether the sequence is long enough.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.xml_nodes import qname
from .model import ComplexType, ElementDecl, Group, Particle, QName, Schema
from .namespaces import Wildcard

MAX_POSITIONS = 4096
ANY_OTHER = "*"


class Declined(ValueError):
    """A model that gets no verdict."""


@dataclass
class Automaton:
    """States are sets of positions, numbered; 0 is the start.  ``moves`` has a
    transition per name; ``others`` one for names under a wildcard."""

    moves: list[dict[str, tuple[int, str]]] = field(default_factory=list)  # name -> (state, label)
    others: list[list[tuple[Wildcard, int, str]]] = field(default_factory=list)
    accepting: list[bool] = field(default_factory=list)
    labels: dict[str, ElementDecl | Wildcard] = field(default_factory=dict)

    def step(self, state: int, name: QName) -> tuple[int, str] | None:
        found = self.moves[state].get(qname(*name))
        if found:
            return found
        return next(((s, label) for w, s, label in self.others[state] if w.admits(name)), None)

    def match(self, names: list[QName]) -> tuple[bool, int | None, list[str]]:
        """(accepted, index of the first child not admitted, labels)."""
        state, out = 0, []
        for i, n in enumerate(names):
            found = self.step(state, n)
            if found is None:
                return False, i, out
            state = found[0]
            out.append(found[1])
        return self.accepting[state], None, out

    def alphabet(self) -> set[str]:
        return {n for m in self.moves for n in m}

    # on columns ----------------------------------------------------------

    def fold(self, children: Column) -> Column:
        """``STRUCT<state, reject>`` over an array of names: the state reached,
        and the index of the first child not admitted, or -1."""
        # by state, so that a step searches the names of one state only
        none = F.expr("cast(map() as map<string, int>)")
        known = F.array(*[F.create_map(*[F.lit(x) for n, (t, _) in m.items() for x in (n, t)]) if m else none for m in self.moves])

        def next_state(acc: Column, x: Column) -> Column:
            to = F.try_element_at(F.get(known, acc["state"]), x)
            for s, ws in enumerate(self.others):
                for w, t, _ in ws:
                    ns = F.when(x.startswith("{"), F.regexp_extract(x, r"^\{(.*)\}", 1)).otherwise("")
                    admitted = (acc["state"] == s) & w.column(ns, F.regexp_replace(x, r"^\{.*\}", ""))
                    to = F.coalesce(to, F.when(admitted, F.lit(t)))
            stopped = acc["reject"] >= 0
            return F.struct(F.when(stopped | to.isNull(), acc["state"]).otherwise(to).alias("state"), F.when(stopped, acc["reject"]).when(to.isNull(), acc["at"]).otherwise(F.lit(-1)).alias("reject"), (acc["at"] + 1).alias("at"))

        start = F.struct(F.lit(0).alias("state"), F.lit(-1).alias("reject"), F.lit(0).alias("at"))
        return F.aggregate(children, start, next_state)

    def verdict(self, children: Column) -> Column:
        """``STRUCT<ok, reject_index, too_short>``."""
        done = [i for i, a in enumerate(self.accepting) if a]
        return F.get(F.transform(F.array(self.fold(children)), lambda r: F.struct(((r["reject"] < 0) & r["state"].isin(*done) if done else F.lit(False)).alias("ok"), F.when(r["reject"] >= 0, r["reject"]).alias("reject_index"), ((r["reject"] < 0) & ~r["state"].isin(*done) if done else r["reject"] < 0).alias("too_short"))), 0)


class _Builder:
    """Glushkov positions of a particle, with counts unrolled."""

    def __init__(self, schema: Schema | None):
        self.schema = schema
        self.terms: list[ElementDecl | Wildcard] = []
        self.follow: list[set[int]] = []

    def position(self, term) -> int:
        if len(self.terms) >= MAX_POSITIONS:
            raise Declined(f"over {MAX_POSITIONS} positions")
        self.terms.append(term)
        self.follow.append(set())
        return len(self.terms) - 1

    def term(self, t) -> tuple[set[int], set[int], bool]:
        """(first, last, can it be empty)."""
        if not isinstance(t, Group):
            p = self.position(t)
            return {p}, {p}, False
        if t.compositor == "all":
            raise Declined("an all group inside a model")
        if t.compositor == "choice":
            first, last, empty = set(), set(), not t.particles
            for p in t.particles:
                f, l, e = self.particle(p)
                first |= f
                last |= l
                empty |= e
            return first, last, empty if t.particles else False
        return self.sequence([self.particle(p) for p in t.particles])

    def sequence(self, parts) -> tuple[set[int], set[int], bool]:
        first, last, empty = set(), set(), True
        for f, l, e in parts:
            for x in last:
                self.follow[x] |= f
            first |= f if empty else set()
            last = (last | l) if e else set(l)
            empty &= e
        return first, last, empty

    def particle(self, p: Particle) -> tuple[set[int], set[int], bool]:
        low, high = p.occurs.low, p.occurs.high
        if high == 0:
            return set(), set(), True
        parts = []
        for _ in range(max(low, 1) if high is None else low):
            parts.append(self.term(p.term))
        if high is None:
            f, l, e = parts[-1]
            for x in l:
                self.follow[x] |= f
            parts[-1] = (f, l, e or low == 0)
        else:
            rest: tuple[set[int], set[int], bool] | None = None
            made = [self.term(p.term) for _ in range(high - low)]
            for f, l, e in reversed(made):  # a(a(a)?)? keeps the model deterministic
                rest = self.sequence([(f, l, e), rest]) if rest else (f, l, e)
                rest = (rest[0], rest[1], True)
            if rest:
                parts.append(rest)
        return self.sequence(parts)


def names_of(term: ElementDecl, schema: Schema | None) -> list[ElementDecl]:
    """The declarations that may stand for an element particle."""
    if schema is not None and term.is_global and term.name in schema.elements:
        return schema.members(term.name)
    return [term]


def automaton(t: ComplexType, schema: Schema | None = None) -> Automaton:
    """The automaton of a complex type's content, or Declined."""
    if t.open_content is not None:
        raise Declined("open content")
    if t.particle is None:
        return Automaton([{}], [[]], [True])
    if isinstance(t.particle.term, Group) and t.particle.term.compositor == "all":
        return _all_group(t.particle, schema)
    b = _Builder(schema)
    first, last, empty = b.particle(t.particle)
    return _determinize(b.terms, b.follow, first, last, empty, schema)


def _label(a: Automaton, term) -> str:
    key = f"e{id(term)}" if isinstance(term, ElementDecl) else f"w{id(term)}"
    a.labels[key] = term
    return key


def _determinize(terms, follow, first, last, empty, schema) -> Automaton:
    a = Automaton()
    start = (frozenset([-1]),)
    number: dict[frozenset[int], int] = {}
    todo: list[frozenset[int]] = []

    def state(s: frozenset[int]) -> int:
        if s not in number:
            if len(number) > MAX_POSITIONS:
                raise Declined(f"over {MAX_POSITIONS} states")
            number[s] = len(number)
            todo.append(s)
            a.moves.append({})
            a.others.append([])
            a.accepting.append((-1 in s and empty) or bool(s & last))
        return number[s]

    state(start[0])
    while todo:
        s = todo.pop(0)
        i = number[s]
        reach = set().union(*[first if p == -1 else follow[p] for p in s])
        by: dict[str, tuple[set[int], str]] = {}
        wild: list[tuple[Wildcard, int]] = []
        for p in sorted(reach):
            if isinstance(terms[p], Wildcard):
                wild.append((terms[p], p))
                continue
            for e in names_of(terms[p], schema):
                key = qname(*e.name)
                by.setdefault(key, (set(), _label(a, e)))[0].add(p)
        for key, (ps, label) in by.items():
            a.moves[i][key] = (state(frozenset(ps)), label)
        for w, p in wild:
            a.others[i].append((w, state(frozenset([p])), _label(a, w)))
    return a


def _all_group(p: Particle, schema) -> Automaton:
    """Counts per member, saturating: any order."""
    parts: list[Particle] = []

    def flat(g: Group) -> None:
        for q in g.particles:
            if isinstance(q.term, Group):
                flat(q.term)
            else:
                parts.append(q)

    flat(p.term)
    a = Automaton()
    number: dict[tuple[int, ...], int] = {}
    todo: list[tuple[int, ...]] = []

    def state(c: tuple[int, ...]) -> int:
        if c not in number:
            if len(number) > MAX_POSITIONS:
                raise Declined("an all group with too many states")
            number[c] = len(number)
            todo.append(c)
            a.moves.append({})
            a.others.append([])
            done = all(n >= q.occurs.low for n, q in zip(c, parts))
            a.accepting.append(done or (p.occurs.low == 0 and not any(c)))
        return number[c]

    state((0,) * len(parts))
    while todo:
        c = todo.pop(0)
        i = number[c]
        for k, q in enumerate(parts):
            if q.occurs.high is not None and c[k] >= q.occurs.high:
                continue
            n = c[k] + 1 if q.occurs.high is not None or c[k] < q.occurs.low else c[k]
            to = state((*c[:k], n, *c[k + 1 :]))
            if isinstance(q.term, Wildcard):
                a.others[i].append((q.term, to, _label(a, q.term)))
            else:
                for e in names_of(q.term, schema):
                    a.moves[i].setdefault(qname(*e.name), (to, _label(a, e)))
    return a


def ambiguous(t: ComplexType, schema: Schema | None = None) -> str | None:
    """A name that two particles compete for, or None (cos-nonambig).  An
    element before a wildcard is no competition."""
    if t.particle is None or (isinstance(t.particle.term, Group) and t.particle.term.compositor == "all"):
        return None
    b = _Builder(schema)
    try:
        first, _, _ = b.particle(t.particle)
    except Declined:
        return None
    origin = {i: id(x) for i, x in enumerate(b.terms)}
    for reach in [first, *b.follow]:
        seen: dict[str, int] = {}
        wild: list[int] = []
        for p in reach:
            x = b.terms[p]
            if isinstance(x, Wildcard):
                from .namespaces import intersect

                for q in wild:
                    c = intersect(b.terms[q].constraint, x.constraint)
                    if origin[q] != origin[p] and not (c.variety == "enumeration" and not c.names):
                        return "a wildcard"
                wild.append(p)
                continue
            for e in names_of(x, schema):
                key = qname(*e.name)
                if seen.setdefault(key, origin[p]) != origin[p]:
                    return key
    return None


def included(a: Automaton, b: Automaton) -> bool:
    """Is every sequence that ``a`` accepts accepted by ``b``?"""
    seen, todo = {(0, 0)}, [(0, 0)]
    while todo:
        s, t = todo.pop()
        if a.accepting[s] and not b.accepting[t]:
            return False
        for name, (s2, _) in a.moves[s].items():
            ns, _, local = name[1:].rpartition("}") if name.startswith("{") else ("", "", name)
            found = b.step(t, (ns, local))
            if found is None:
                if _dead(a, s2):
                    continue
                return False
            if (s2, found[0]) not in seen:
                seen.add((s2, found[0]))
                todo.append((s2, found[0]))
        for w, s2, _ in a.others[s]:
            from .namespaces import subset

            found = next((t2 for v, t2, _ in b.others[t] if subset(w.constraint, v.constraint)), None)
            if found is None:
                return False
            if (s2, found) not in seen:
                seen.add((s2, found))
                todo.append((s2, found))
    return True


def _dead(a: Automaton, s: int) -> bool:
    seen, todo = {s}, [s]
    while todo:
        x = todo.pop()
        if a.accepting[x]:
            return False
        for t in [t for t, _ in a.moves[x].values()] + [t for _, t, _ in a.others[x]]:
            if t not in seen:
                seen.add(t)
                todo.append(t)
    return True
