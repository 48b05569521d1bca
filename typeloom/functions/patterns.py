"""Schema and XPath regular expressions as Java regular expressions.

Classes are worked out as sorted code point ranges and written as ranges, so a
pattern means the same to any engine that reads ranges; Java's own shorthand
classes differ from the schema language's and are never used.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

MAX = sys.maxunicode
MAX_REPEAT = 1000
Ranges = tuple[tuple[int, int], ...]


class PatternError(ValueError):
    """``rule`` is src-pattern-value, err:FORX0001 or err:FORX0002."""

    def __init__(self, rule: str, message: str):
        super().__init__(f"[{rule}] {message}")
        self.rule = rule


# range sets ------------------------------------------------------------------


def union(*sets: Ranges) -> Ranges:
    out: list[list[int]] = []
    for a, b in sorted(r for s in sets for r in s):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return tuple((a, b) for a, b in out)


def complement(s: Ranges) -> Ranges:
    out, at = [], 0
    for a, b in union(s):
        if at < a:
            out.append((at, a - 1))
        at = b + 1
    if at <= MAX:
        out.append((at, MAX))
    return tuple(out)


def difference(a: Ranges, b: Ranges) -> Ranges:
    return complement(union(complement(a), b))


def intersection(a: Ranges, b: Ranges) -> Ranges:
    return complement(union(complement(a), complement(b)))


def chars(text: str) -> Ranges:
    return union(tuple((ord(c), ord(c)) for c in text))


@lru_cache(maxsize=None)
def category(name: str) -> Ranges:
    """Code points of a general category, or of all that begin with a letter."""
    known = {"L": "ultmo", "M": "nce", "N": "dlo", "P": "cdseifo", "Z": "slp", "S": "mcko", "C": "cofn"}
    if not name or name[0] not in known or len(name) > 2 or (len(name) == 2 and name[1] not in known[name[0]]):
        raise KeyError(name)
    out, start = [], None
    for c in range(MAX + 2):
        inside = c <= MAX and not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)).startswith(name)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append((start, c - 1))
            start = None
    return tuple(out)


BLOCKS: dict[str, tuple[int, int]] = {
    "BasicLatin": (0, 0x7F), "Latin-1Supplement": (0x80, 0xFF), "LatinExtended-A": (0x100, 0x17F), "LatinExtended-B": (0x180, 0x24F), "IPAExtensions": (0x250, 0x2AF), "SpacingModifierLetters": (0x2B0, 0x2FF),
    "CombiningDiacriticalMarks": (0x300, 0x36F), "Greek": (0x370, 0x3FF), "GreekandCoptic": (0x370, 0x3FF), "Cyrillic": (0x400, 0x4FF), "CyrillicSupplement": (0x500, 0x52F), "Armenian": (0x530, 0x58F), "Hebrew": (0x590, 0x5FF),
    "Arabic": (0x600, 0x6FF), "Syriac": (0x700, 0x74F), "Thaana": (0x780, 0x7BF), "Devanagari": (0x900, 0x97F), "Bengali": (0x980, 0x9FF), "Gurmukhi": (0xA00, 0xA7F), "Gujarati": (0xA80, 0xAFF), "Oriya": (0xB00, 0xB7F),
    "Tamil": (0xB80, 0xBFF), "Telugu": (0xC00, 0xC7F), "Kannada": (0xC80, 0xCFF), "Malayalam": (0xD00, 0xD7F), "Sinhala": (0xD80, 0xDFF), "Thai": (0xE00, 0xE7F), "Lao": (0xE80, 0xEFF), "Tibetan": (0xF00, 0xFFF),
    "Myanmar": (0x1000, 0x109F), "Georgian": (0x10A0, 0x10FF), "HangulJamo": (0x1100, 0x11FF), "Ethiopic": (0x1200, 0x137F), "Cherokee": (0x13A0, 0x13FF), "Ogham": (0x1680, 0x169F), "Runic": (0x16A0, 0x16FF), "Khmer": (0x1780, 0x17FF),
    "Mongolian": (0x1800, 0x18AF), "LatinExtendedAdditional": (0x1E00, 0x1EFF), "GreekExtended": (0x1F00, 0x1FFF), "GeneralPunctuation": (0x2000, 0x206F), "SuperscriptsandSubscripts": (0x2070, 0x209F), "CurrencySymbols": (0x20A0, 0x20CF),
    "CombiningMarksforSymbols": (0x20D0, 0x20FF), "CombiningDiacriticalMarksforSymbols": (0x20D0, 0x20FF), "LetterlikeSymbols": (0x2100, 0x214F), "NumberForms": (0x2150, 0x218F), "Arrows": (0x2190, 0x21FF), "MathematicalOperators": (0x2200, 0x22FF),
    "MiscellaneousTechnical": (0x2300, 0x23FF), "ControlPictures": (0x2400, 0x243F), "OpticalCharacterRecognition": (0x2440, 0x245F), "EnclosedAlphanumerics": (0x2460, 0x24FF), "BoxDrawing": (0x2500, 0x257F), "BlockElements": (0x2580, 0x259F),
    "GeometricShapes": (0x25A0, 0x25FF), "MiscellaneousSymbols": (0x2600, 0x26FF), "Dingbats": (0x2700, 0x27BF), "BraillePatterns": (0x2800, 0x28FF), "CJKRadicalsSupplement": (0x2E80, 0x2EFF), "KangxiRadicals": (0x2F00, 0x2FDF),
    "IdeographicDescriptionCharacters": (0x2FF0, 0x2FFF), "CJKSymbolsandPunctuation": (0x3000, 0x303F), "Hiragana": (0x3040, 0x309F), "Katakana": (0x30A0, 0x30FF), "Bopomofo": (0x3100, 0x312F), "HangulCompatibilityJamo": (0x3130, 0x318F),
    "Kanbun": (0x3190, 0x319F), "BopomofoExtended": (0x31A0, 0x31BF), "EnclosedCJKLettersandMonths": (0x3200, 0x32FF), "CJKCompatibility": (0x3300, 0x33FF), "CJKUnifiedIdeographsExtensionA": (0x3400, 0x4DBF), "CJKUnifiedIdeographs": (0x4E00, 0x9FFF),
    "YiSyllables": (0xA000, 0xA48F), "YiRadicals": (0xA490, 0xA4CF), "HangulSyllables": (0xAC00, 0xD7AF), "PrivateUse": (0xE000, 0xF8FF), "PrivateUseArea": (0xE000, 0xF8FF), "CJKCompatibilityIdeographs": (0xF900, 0xFAFF),
    "AlphabeticPresentationForms": (0xFB00, 0xFB4F), "ArabicPresentationForms-A": (0xFB50, 0xFDFF), "CombiningHalfMarks": (0xFE20, 0xFE2F), "CJKCompatibilityForms": (0xFE30, 0xFE4F), "SmallFormVariants": (0xFE50, 0xFE6F),
    "ArabicPresentationForms-B": (0xFE70, 0xFEFF), "HalfwidthandFullwidthForms": (0xFF00, 0xFFEF), "Specials": (0xFFF0, 0xFFFF), "OldItalic": (0x10300, 0x1032F), "Gothic": (0x10330, 0x1034F), "Deseret": (0x10400, 0x1044F),
    "ByzantineMusicalSymbols": (0x1D000, 0x1D0FF), "MusicalSymbols": (0x1D100, 0x1D1FF), "MathematicalAlphanumericSymbols": (0x1D400, 0x1D7FF), "CJKUnifiedIdeographsExtensionB": (0x20000, 0x2A6DF), "CJKCompatibilityIdeographsSupplement": (0x2F800, 0x2FA1F), "Tags": (0xE0000, 0xE007F),
}

_NAME_START: Ranges = ((0x3A, 0x3A), (0x41, 0x5A), (0x5F, 0x5F), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x2FF), (0x370, 0x37D), (0x37F, 0x1FFF), (0x200C, 0x200D), (0x2070, 0x218F), (0x2C00, 0x2FEF), (0x3001, 0xD7FF), (0xF900, 0xFDCF), (0xFDF0, 0xFFFD), (0x10000, 0xEFFFF))
_NAME: Ranges = union(_NAME_START, ((0x2D, 0x2E), (0x30, 0x39), (0xB7, 0xB7), (0x300, 0x36F), (0x203F, 0x2040)))


@lru_cache(maxsize=None)
def escape_class(letter: str) -> Ranges:
    """The set of ``\\s \\i \\c \\d \\w`` and of their capitals' complements."""
    if letter.isupper():
        return complement(escape_class(letter.lower()))
    return {"s": lambda: chars("\t\n\r "), "i": lambda: _NAME_START, "c": lambda: _NAME, "d": lambda: category("Nd"), "w": lambda: complement(union(category("P"), category("Z"), category("C")))}[letter]()


def spell(c: int) -> str:
    return f"\\x{{{c:x}}}"


def to_class(s: Ranges) -> str:
    """A character class of ranges; one that matches nothing for no range."""
    if not s:
        return "[^\\x{0}-\\x{10ffff}]"
    return "[" + "".join(spell(a) if a == b else f"{spell(a)}-{spell(b)}" for a, b in s) + "]"


# translation -----------------------------------------------------------------

_SINGLE = {"n": "\n", "r": "\r", "t": "\t"} | {c: c for c in "\\|.?*+(){}-[]^"}
_META = set(".\\?*+()|[]{}")


class _Parser:
    def __init__(self, text: str, fo: bool, flags: str):
        self.text, self.at, self.fo, self.flags = text, 0, fo, flags
        self.rule = "err:FORX0002" if fo else "src-pattern-value"

    def fail(self, message: str):
        raise PatternError(self.rule, f"{message} at {self.at} of {self.text!r}")

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def alternatives(self) -> str:
        out = [self.branch()]
        while self.peek() == "|":
            self.at += 1
            out.append(self.branch())
        return "|".join(out)

    def branch(self) -> str:
        out = []
        while (c := self.peek()) and c not in "|)":
            out.append(self.piece())
        return "".join(out)

    def piece(self) -> str:
        atom = self.atom()
        c = self.peek()
        if c and c in "?*+":
            self.at += 1
            lazy = self.lazy()
            return f"{atom}{c}{lazy}"
        if c == "{":
            end = self.text.find("}", self.at)
            body = self.text[self.at + 1 : end] if end > 0 else ""
            parts = body.split(",")
            if end < 0 or len(parts) > 2 or not parts[0].isascii() or not parts[0].isdigit() or not (len(parts) < 2 or parts[1] == "" or (parts[1].isascii() and parts[1].isdigit())):
                self.fail("a malformed quantifier")
            low = int(parts[0])
            high = low if len(parts) == 1 else (None if parts[1] == "" else int(parts[1]))
            if high is not None and low > high:
                self.fail("a quantifier whose range is empty")
            if max(low, high or 0) > MAX_REPEAT:
                self.fail(f"a repeat of over {MAX_REPEAT}")
            self.at = end + 1
            lazy = self.lazy()
            return f"{atom}{{{body}}}{lazy}"
        return atom

    def lazy(self) -> str:
        if self.fo and self.peek() == "?":
            self.at += 1
            return "?"
        return ""

    def atom(self) -> str:
        c = self.peek()
        self.at += 1
        if c == "(":
            if self.fo and self.text.startswith("?:", self.at):
                self.at += 2
                opening = "(?:"
            else:
                opening = "(" if self.fo else "(?:"
            inner = self.alternatives()
            if self.peek() != ")":
                self.fail("an unclosed group")
            self.at += 1
            return f"{opening}{inner})"
        if c == "[":
            return to_class(self.klass())
        if c == ".":
            if self.fo and "s" in self.flags:
                return "[\\x{0}-\\x{10ffff}]"
            return "[^\\n\\r]"
        if c == "\\":
            return self.escape()
        if c in "^$" and self.fo:
            if "m" in self.flags:
                return {"^": "(?:^|(?<=\\n))", "$": "(?:\\z|(?=\\n))"}[c]
            return {"^": "\\A", "$": "\\z"}[c]
        if c in _META:
            self.at -= 1
            self.fail(f"an unescaped {c!r}")
        return self.literal(c)

    def literal(self, c: str) -> str:
        return c if c.isascii() and c.isalnum() else spell(ord(c))

    def escape(self) -> str:
        c = self.peek()
        if c and c in "pP":
            return to_class(self.property())
        if c and c in "sSiIcCdDwW":
            self.at += 1
            return to_class(escape_class(c))
        if c and (c in _SINGLE or (self.fo and c == "$")):
            self.at += 1
            return spell(ord(_SINGLE.get(c, c)))
        self.fail("a back-reference" if c.isdigit() else "an unknown escape")

    def property(self) -> Ranges:
        negate = self.peek() == "P"
        end = self.text.find("}", self.at)
        if self.text[self.at + 1 : self.at + 2] != "{" or end < 0:
            self.fail("a malformed property escape")
        name = self.text[self.at + 2 : end]
        try:
            s = (BLOCKS[name[2:]],) if name.startswith("Is") else category(name)
        except KeyError:
            self.fail(f"an unknown category or block {name!r}")
        self.at = end + 1
        return complement(s) if negate else s

    def klass(self) -> Ranges:
        negate = self.peek() == "^"
        self.at += negate
        parts: list[Ranges] = []
        minus: Ranges = ()
        first = True
        while True:
            c = self.peek()
            if not c:
                self.fail("an unclosed class")
            if c == "]" and not first:
                self.at += 1
                break
            if c == "-" and self.text.startswith("-[", self.at) and not first:
                self.at += 2
                minus = self.klass()
                if self.peek() != "]":
                    self.fail("text after a subtraction")
                self.at += 1
                break
            first = False
            low = self.member()
            if isinstance(low, tuple):
                parts.append(low)
                continue
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", "[", ""):
                self.at += 1
                high = self.member()
                if isinstance(high, tuple) or high < low:
                    self.fail("a malformed range")
                parts.append(((low, high),))
            else:
                parts.append(((low, low),))
        s = union(*parts)
        return difference(complement(s) if negate else s, minus)

    def member(self) -> int | Ranges:
        c = self.peek()
        self.at += 1
        if c == "\\":
            e = self.peek()
            if e and e in "pP":
                return self.property()
            self.at += 1
            if e and e in "sSiIcCdDwW":
                return escape_class(e)
            if e and (e in _SINGLE or (self.fo and e == "$")):
                return ord(_SINGLE.get(e, e))
            self.fail("an unknown escape in a class")
        if c in ("[", "]", ""):
            self.fail("an unescaped bracket in a class")
        return ord(c)


@lru_cache(maxsize=4096)
def translate(pattern: str, flavor: str = "xsd", flags: str = "") -> str:
    """A Java pattern for ``rlike``.  ``xsd``: anchored, no flags; ``fo``: where
    it matches, with flags of ``ismx``."""
    fo = flavor == "fo"
    if fo:
        for f in flags:
            if f not in "ismx":
                raise PatternError("err:FORX0001", f"unknown flag {f!r}")
        if "x" in flags:
            out, depth, k = [], 0, 0
            while k < len(pattern):
                c = pattern[k]
                if c == "\\":
                    out.append(pattern[k : k + 2])
                    k += 2
                    continue
                depth += (c == "[") - (c == "]")
                if depth or c not in " \t\n\r":
                    out.append(c)
                k += 1
            pattern = "".join(out)
    elif flags:
        raise PatternError("src-pattern-value", "a schema pattern takes no flags")
    p = _Parser(pattern, fo, flags)
    body = p.alternatives()
    if p.at < len(pattern):
        p.fail("an unmatched bracket")
    head = "(?iu)" if "i" in flags else ""
    return f"{head}{body}" if fo else f"\\A(?:{body})\\z"


def re2(java: str) -> str:
    """The same pattern for an RE2 engine."""
    return java.replace("(?iu)", "(?i)")
