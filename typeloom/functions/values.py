"""Value spaces as Column expressions, and a Python twin for facet values.

Every primitive has ``ok`` (is the normalised literal in the lexical space),
``canonical``, and keys: ``eq`` (equal values have equal keys), ``order`` where
the space is ordered.  Numbers of any size compare as order-preserving strings;
times compare as whole seconds and then by the digits of the fraction, however
many, with an absent timezone standing for every offset up to 14 hours, so a
comparison may be neither way.  Short literals are worked out in 64 bits, long
ones in decimals; what fits in neither has no verdict, never a wrong one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import ROUND_FLOOR, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import translate

#: Whole seconds and months beyond 64 bits; components of up to 28 digits fit.
WIDE, COMPONENT = "decimal(38,0)", "decimal(28,0)"
#: Literals of durations up to this length have components that fit in 64 bits.
SHORT = 15
#: Years of so many digits have seconds that fit in 64 bits; a year of more than
#: ``LONGEST_YEAR`` digits leaves comparisons open.
SHORT_YEAR, LONGEST_YEAR = 11, 13
_NUMBER = r"([0-9]+(\.[0-9]*)?|\.[0-9]+)"
_YEAR = r"-?([1-9][0-9]{3,}|0[0-9]{3})"
_MONTH, _DAY = "(0[1-9]|1[0-2])", "(0[1-9]|[12][0-9]|3[01])"
_TIME = r"(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?|24:00:00(\.0+)?)"
_ZONE = r"(Z|[+-]((0[0-9]|1[0-3]):[0-5][0-9]|14:00))?"
_DAYTIME = r"(([0-9]+D)?(T([0-9]+H)?([0-9]+M)?([0-9]+(\.[0-9]+)?S)?)?)"

#: The lexical spaces, as anchored Java patterns.
LEXICAL: dict[str, str] = {
    "boolean": r"\A(true|false|1|0)\z",
    "decimal": rf"\A[+-]?{_NUMBER}\z",
    "float": rf"\A([+-]?{_NUMBER}([eE][+-]?[0-9]+)?|[+-]?INF|NaN)\z",
    "duration": rf"\A-?P(?=[0-9T])([0-9]+Y)?([0-9]+M)?{_DAYTIME}(?<!T)\z",
    "yearMonthDuration": r"\A-?P(?=[0-9])([0-9]+Y)?([0-9]+M)?\z",
    "dayTimeDuration": rf"\A-?P(?=[0-9T]){_DAYTIME}(?<!T)\z",
    "dateTime": rf"\A{_YEAR}-{_MONTH}-{_DAY}T{_TIME}{_ZONE}\z",
    "time": rf"\A{_TIME}{_ZONE}\z",
    "date": rf"\A{_YEAR}-{_MONTH}-{_DAY}{_ZONE}\z",
    "gYearMonth": rf"\A{_YEAR}-{_MONTH}{_ZONE}\z",
    "gYear": rf"\A{_YEAR}{_ZONE}\z",
    "gMonthDay": rf"\A--(?!0[2469]-31|11-31|02-30){_MONTH}-{_DAY}{_ZONE}\z",
    "gDay": rf"\A---{_DAY}{_ZONE}\z",
    "gMonth": rf"\A--{_MONTH}{_ZONE}\z",
    "hexBinary": r"\A([0-9a-fA-F]{2})*\z",
    "base64Binary": r"\A((([A-Za-z0-9+/] ?){4})*(([A-Za-z0-9+/] ?){3}[A-Za-z0-9+/]|([A-Za-z0-9+/] ?){2}[AEIMQUYcgkosw048] ?=|[A-Za-z0-9+/] ?[AQgw] ?= ?=))?\z",
}
LEXICAL["double"] = LEXICAL["precisionDecimal"] = LEXICAL["float"]
LEXICAL["dateTimeStamp"] = LEXICAL["dateTime"]
_QNAME = translate(r"([\i-[:]][\c-[:]]*:)?[\i-[:]][\c-[:]]*")

TIMES = ("dateTime", "dateTimeStamp", "time", "date", "gYearMonth", "gYear", "gMonthDay", "gDay", "gMonth")
DURATIONS = ("duration", "yearMonthDuration", "dayTimeDuration")
#: Where comparison is by string keys.
KEYED = ("decimal", "float", "double", "precisionDecimal")


def white(c: Column, mode: str) -> Column:
    """Whitespace normalisation: preserve, replace or collapse."""
    if mode == "preserve":
        return c
    out = F.translate(c, "\t\n\r", "   ")
    return F.trim(F.regexp_replace(out, " +", " ")) if mode == "collapse" else out


def white_text(s: str, mode: str) -> str:
    if mode == "preserve":
        return s
    s = s.translate({9: " ", 10: " ", 13: " "})
    return " ".join(x for x in s.split(" ") if x) if mode == "collapse" else s


# numbers ---------------------------------------------------------------------


def _parts(c: Column) -> tuple[Column, Column, Column]:
    """(negative, integer digits without leading zeros, fraction digits without
    trailing zeros) of a decimal literal."""
    body = F.regexp_replace(c, r"^[+-]", "")
    whole = F.regexp_replace(F.substring_index(body, ".", 1), "^0+", "")
    part = F.when(F.instr(body, ".") > 0, F.regexp_replace(F.substring_index(body, ".", -1), "0+$", "")).otherwise("")
    return c.startswith("-"), whole, part


def order_key(negative: Column, whole: Column, part: Column) -> Column:
    """Strings that order as the numbers do, whatever their size."""
    digits = F.when(whole == "", "0").otherwise(whole)
    tail = F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits, F.lit("."), part)
    zero = (whole == "") & (part == "")
    return F.when(negative & ~zero, F.concat(F.lit("0"), F.translate(tail, "0123456789", "9876543210"), F.lit("~"))).otherwise(F.concat(F.lit("1"), tail))


def split_number(c: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """An expression over the parts of a decimal literal, each taken once."""
    negative, whole, part = _parts(c)
    return let(F.struct(negative.alias("n"), whole.alias("w"), part.alias("p")), lambda v: body(v["n"], v["w"], v["p"]))


def decimal_key(c: Column) -> Column:
    return split_number(c, order_key)


def decimal_canonical(c: Column) -> Column:
    """No plus sign, no needless zeros, no point before nothing."""
    x = F.regexp_replace(c, r"^\+", "")
    x = F.regexp_replace(x, r"(\.[0-9]*?)0+$", "$1")
    x = F.regexp_replace(x, r"\.$", "")
    x = F.regexp_replace(x, r"^(-?)0+(?=[0-9])", "$1")
    x = F.regexp_replace(x, r"^(-?)\.", "$10.")
    # most literals are plain whole numbers, which are canonical as they are
    plain = c.rlike(r"\A(0|-?[1-9][0-9]*)\z")
    return F.when(plain, c).otherwise(F.regexp_replace(x, r"^(|-|-0)$", "0"))


def total_digits(c: Column) -> Column:
    """Digits of the least unscaled value; 1 for zero."""
    return split_number(c, lambda n, w, p: F.greatest(F.lit(1), F.length(F.when(w == "", F.regexp_replace(p, "^0+", "")).otherwise(F.concat(w, p)))))


def fraction_digits(c: Column) -> Column:
    return F.length(_parts(c)[2])


def floating(c: Column, kind: str) -> Column:
    """The number of a literal known to be in the lexical space; what is out of
    range becomes an infinity or zero."""
    plain = F.when(c.endswith("INF"), F.when(c.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).when(c == "NaN", F.lit(float("nan"))).otherwise(c.try_cast("double"))
    return plain.cast("float").cast("double") if kind == "float" else plain


def floating_canonical(c: Column, kind: str) -> Column:
    """One digit before the point and an exponent, the shortest that reads back."""
    v = floating(c, kind)
    text = F.abs(v.cast("float") if kind == "float" else v).cast("string")
    return let(F.struct(v.alias("v"), text.alias("t")), lambda x: _floating_text(c, x["v"], x["t"]))


def _floating_text(c: Column, v: Column, text: Column) -> Column:
    mantissa = F.substring_index(text, "E", 1)
    exp = F.when(F.instr(text, "E") > 0, F.substring_index(text, "E", -1).try_cast("int")).otherwise(F.lit(0))
    whole, part = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
    stripped = F.regexp_replace(F.concat(whole, part), "^0+", "")
    zeros = F.length(whole) + F.length(part) - F.length(stripped)
    short = F.regexp_replace(stripped, "0+$", "")
    sign = F.when(c.startswith("-"), "-").otherwise("")
    power = F.length(whole) + exp - zeros - 1
    rest = F.when(F.length(short) > 1, F.substr(short, F.lit(2))).otherwise("0")
    return F.when(c == "NaN", "NaN").when(v == float("inf"), "INF").when(v == float("-inf"), "-INF").when(v == 0, F.concat(sign, F.lit("0.0E0"))).otherwise(F.concat(sign, F.substring(short, 1, 1), F.lit("."), rest, F.lit("E"), power.cast("string")))


def scientific(c: Column) -> tuple[Column, Column, Column]:
    """(negative, coefficient digits without leading zeros, scale) of a
    precisionDecimal literal that is a number."""
    body = F.regexp_replace(c, r"^[+-]", "")
    mantissa = F.regexp_replace(body, "[eE].*$", "")
    exp = F.coalesce(F.regexp_extract(body, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int"), F.lit(0))
    part = F.when(F.instr(mantissa, ".") > 0, F.length(F.substring_index(mantissa, ".", -1))).otherwise(F.lit(0))
    return c.startswith("-"), F.regexp_replace(F.regexp_replace(mantissa, r"\.", ""), "^0+", ""), part - exp


def _science(c: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    negative, digits, scale = scientific(c)
    return let(F.struct(negative.alias("n"), digits.alias("d"), scale.alias("s")), lambda v: body(v["n"], v["d"], v["s"]))


def precision_key(c: Column) -> Column:
    return _science(c, lambda n, d, s: _precision_key(c, n, d, s))


def _precision_key(c: Column, negative: Column, digits: Column, scale: Column) -> Column:
    padded = F.when(scale < 0, F.concat(digits, F.repeat(F.lit("0"), -scale))).otherwise(digits)
    padded = F.when(scale > 0, F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), scale - F.length(padded))), padded)).otherwise(padded)
    cut = F.length(padded) - F.greatest(F.lit(0), scale)
    whole = F.regexp_replace(F.substr(padded, F.lit(1), cut), "^0+", "")
    part = F.regexp_replace(F.substr(padded, cut + 1), "0+$", "")
    number = F.when(digits == "", F.lit("100000000010.")).otherwise(order_key(negative, whole, part))
    return F.when(c == "-INF", " ").when(c.endswith("INF"), "~").when(c == "NaN", F.lit(None).cast("string")).otherwise(number)


def precision_total(c: Column) -> Column:
    """Digits of the coefficient, trailing zeros included; 1 for zero and for
    what is no number."""
    _, digits, _ = scientific(c)
    return F.when(c.endswith("INF") | (c == "NaN"), 1).otherwise(F.greatest(F.lit(1), F.length(digits)))


def precision_canonical(c: Column) -> Column:
    """Plain notation from 1E-6 up to 1E6 for scales of 0 and more, else an
    exponent; the coefficient's digits stay."""
    return _science(c, lambda n, d, s: _precision_text(c, n, d, s))


def _precision_text(c: Column, negative: Column, digits: Column, scale: Column) -> Column:
    sign = F.when(negative, "-").otherwise("")
    d = F.when(digits == "", "0").otherwise(digits)
    adjusted = F.length(d) - 1 - scale
    plain = F.when(scale == 0, d).when(F.length(d) > scale, F.concat(F.substr(d, F.lit(1), F.length(d) - scale), F.lit("."), F.substr(d, F.length(d) - scale + 1))).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), scale - F.length(d)), d))
    rest = F.when(F.length(d) > 1, F.concat(F.lit("."), F.substr(d, F.lit(2)))).otherwise("")
    science = F.concat(F.substring(d, 1, 1), rest, F.lit("E"), adjusted.cast("string"))
    inside = (scale >= 0) & (adjusted >= -6) & (adjusted < 6)
    return F.when(c == "NaN", "NaN").when(c.endswith("INF"), F.when(negative, "-INF").otherwise("INF")).otherwise(F.concat(sign, F.when(inside, plain).otherwise(science)))


# calendar --------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value that an expression uses many times: it is computed once, and
    the expression does not grow with each use."""
    return F.get(F.transform(F.array(value), body), 0)


def _div(a: Column, b: int) -> Column:
    """Floor division of whole numbers below 2 ** 53."""
    return F.floor(a / F.lit(b)).cast("long")


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 in the proleptic Gregorian calendar."""
    y = y - F.when(m <= 2, 1).otherwise(0)
    return 365 * y + _div(y, 4) - _div(y, 100) + _div(y, 400) + _div(153 * F.pmod(m + 9, F.lit(12)) + 2, 5) + d - 719469


def month_days(y: Column, m: Column) -> Column:
    leap = ((F.pmod(y, F.lit(4)) == 0) & (F.pmod(y, F.lit(100)) != 0)) | (F.pmod(y, F.lit(400)) == 0)
    return F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)


@dataclass
class Moment:
    """Seven properties of a calendar literal; absent ones filled from
    1972-12-31T00:00:00."""

    year: Column
    month: Column
    day: Column
    hour: Column
    minute: Column
    second: Column  # whole
    fraction: Column  # its digits, no zeros at the end
    zone: Column  # minutes, null where absent
    literal: Column
    kind: str

    def seconds(self, wide: bool = False) -> Column:
        """Whole seconds on the timeline, as local time where no zone is given;
        24:00:00 of a time is 00:00:00."""
        days = days_from_civil(self.year, self.month, self.day)
        clock = self.hour * 3600 + self.minute * 60 + self.second - F.coalesce(self.zone, F.lit(0)) * 60
        if self.kind == "time":
            clock = clock - F.when(self.hour == 24, F.lit(86400)).otherwise(F.lit(0))
        return days.cast(COMPONENT) * F.lit(86400) + clock if wide else days * 86400 + clock

    def both_ways(self, body: Callable[[Column], Column]) -> Column:
        """An expression over the seconds: in 64 bits where the year allows it."""
        if self.kind not in ("dateTime", "date", "gYearMonth", "gYear"):
            return body(self.seconds())
        limit = 10**SHORT_YEAR
        return F.when((self.year < limit) & (self.year > -limit), body(self.seconds())).otherwise(body(self.seconds(True)))


def moment(c: Column, kind: str) -> Moment:
    kind = "dateTime" if kind == "dateTimeStamp" else kind
    group = lambda p, i: F.regexp_extract(c, p, i)
    number = lambda s, default: F.coalesce(s.try_cast("long"), F.lit(default).cast("long"))
    year, month, day = F.lit(1972).cast("long"), F.lit(12).cast("long"), F.lit(31).cast("long")
    if kind in ("dateTime", "date", "gYearMonth", "gYear"):
        text = group(r"^(-?[0-9]+)", 1)
        year = F.when(F.length(text) <= LONGEST_YEAR, text.try_cast("long"))  # beyond, a comparison stays open
    if kind in ("dateTime", "date", "gYearMonth"):
        month = number(group(r"^-?[0-9]+-([0-9]{2})", 1), 12)
    if kind in ("dateTime", "date"):
        day = number(group(r"^-?[0-9]+-[0-9]{2}-([0-9]{2})", 1), 31)
    if kind in ("gMonthDay", "gMonth"):
        month = number(group(r"^--([0-9]{2})", 1), 12)
    if kind == "gMonthDay":
        day = number(group(r"^--[0-9]{2}-([0-9]{2})", 1), 31)
    if kind == "gDay":
        day = number(group(r"^---([0-9]{2})", 1), 31)
    if kind in ("gYearMonth", "gMonth"):
        day = month_days(year, month).cast("long")
    hour = minute = F.lit(0).cast("long")
    second, fraction = F.lit(0).cast("long"), F.lit("")
    if kind in ("dateTime", "time"):
        hour = number(group(r"([0-9]{2}):[0-9]{2}:[0-9]{2}", 1), 0)
        minute = number(group(r"[0-9]{2}:([0-9]{2}):[0-9]{2}", 1), 0)
        second = number(group(r"[0-9]{2}:[0-9]{2}:([0-9]{2})", 1), 0)
        fraction = F.rtrim(group(r":[0-9]{2}\.([0-9]+)", 1), F.lit("0"))
    zone = group(r"(Z|[+-][0-9]{2}:[0-9]{2})$", 1)
    if kind in ("date", "gYearMonth", "gYear", "gMonthDay", "gDay", "gMonth"):
        zone = group(r"(Z|[+-][0-9]{2}:[0-9]{2})$", 1)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    minutes = sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int"))
    offset = F.when(zone == "", F.lit(None).cast("int")).when(zone == "Z", 0).otherwise(minutes)
    return Moment(year, month, day, hour, minute, second, fraction, offset, c, kind)


def bound(c: Column, kind: str, body: Callable[[Moment], Column]) -> Column:
    """An expression over a literal's properties, each taken from it once."""
    m = moment(c, kind)
    names = ("year", "month", "day", "hour", "minute", "second", "fraction", "zone")
    return let(F.struct(*[getattr(m, n).alias(n) for n in names]), lambda v: body(Moment(*[v[n] for n in names], c, m.kind)))


def moment_ok(c: Column, kind: str) -> Column:
    ok = c.rlike(LEXICAL[kind])
    if kind in ("dateTime", "dateTimeStamp", "date"):
        ok = ok & bound(c, kind, lambda m: F.coalesce(m.day <= month_days(m.year, m.month), m.day <= 28))
    return ok


def _year_text(y: Column) -> Column:
    return F.concat(F.when(y < 0, "-").otherwise(""), F.when(F.abs(y) < 10000, F.lpad(F.abs(y).cast("string"), 4, "0")).otherwise(F.abs(y).cast("string")))


def moment_canonical(c: Column, kind: str) -> Column:
    return bound(c, kind, lambda m: _moment_text(c, m, kind))


def _moment_text(c: Column, m: Moment, kind: str) -> Column:
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    zone = F.when(m.zone.isNull(), "").when(m.zone == 0, "Z").otherwise(F.concat(F.when(m.zone < 0, "-").otherwise("+"), two(_div(F.abs(m.zone), 60)), F.lit(":"), two(F.pmod(F.abs(m.zone), F.lit(60)))))
    if kind in ("dateTime", "dateTimeStamp", "time"):
        fraction = F.regexp_replace(F.regexp_extract(c, r":[0-9]{2}(\.[0-9]+)", 1), r"\.?0+$", "")
        midnight = m.hour == 24
        clock = F.when(midnight, "00:00:00").otherwise(F.concat(two(m.hour), F.lit(":"), two(m.minute), F.lit(":"), F.regexp_extract(c, r"[0-9]{2}:[0-9]{2}:([0-9]{2})", 1), fraction))
        if kind == "time":
            return F.concat(clock, zone)
        last = m.day == month_days(m.year, m.month)
        over = midnight & last & (m.month == 12)
        y = m.year + F.when(over, 1).otherwise(0)
        mo = F.when(over, 1).otherwise(m.month + F.when(midnight & last, 1).otherwise(0))
        d = F.when(midnight, F.when(last, 1).otherwise(m.day + 1)).otherwise(m.day)
        return F.concat(_year_text(y), F.lit("-"), two(mo), F.lit("-"), two(d), F.lit("T"), clock, zone)
    text = {"date": lambda: F.concat(_year_text(m.year), F.lit("-"), two(m.month), F.lit("-"), two(m.day)), "gYearMonth": lambda: F.concat(_year_text(m.year), F.lit("-"), two(m.month)), "gYear": lambda: _year_text(m.year), "gMonthDay": lambda: F.concat(F.lit("--"), two(m.month), F.lit("-"), two(m.day)), "gDay": lambda: F.concat(F.lit("---"), two(m.day)), "gMonth": lambda: F.concat(F.lit("--"), two(m.month))}[kind]()
    return F.concat(text, zone)


def in_order(w: Column, f: Column, w2: Column, f2: Column) -> Column:
    """-1, 0 or 1 of whole numbers and then of their fractions' digits; null
    where a whole number is."""
    return F.when(w < w2, -1).when(w > w2, 1).when(w == w2, F.when(f < f2, -1).when(f > f2, 1).otherwise(0))


def compare_moments(a: Column, b: Column | str, kind: str) -> Column:
    """-1, 0 or 1; null where a missing zone leaves it open."""

    def way(p: Moment, w2: Column, f2: Column, here: Column) -> Column:
        f, reach = p.fraction, F.lit(14 * 3600)
        some = lambda w: F.when(here, in_order(w, f, w2, f2)).when(in_order(w + reach, f, w2, f2) < 0, -1).when(in_order(w - reach, f, w2, f2) > 0, 1)
        return p.both_ways(some)

    if isinstance(b, str):
        w, f, zoned = moment_of(b, kind)
        number = F.lit(w) if abs(w) < 1 << 62 else F.lit(Decimal(w)).cast(WIDE)
        return bound(a, kind, lambda p: way(p, number, F.lit(f), p.zone.isNotNull() if zoned else p.zone.isNull()))

    def second(q: Moment) -> Column:
        # both in decimals if one has to be
        return F.struct(q.both_ways(lambda w: w.cast(WIDE)).alias("w"), q.fraction.alias("f"), q.zone.isNull().alias("z"))

    return let(bound(b, kind, second), lambda v: bound(a, kind, lambda p: way(p, v["w"], v["f"], p.zone.isNull() == v["z"])))


# durations -------------------------------------------------------------------

_STARTS = ((1696, 9), (1697, 2), (1903, 3), (1903, 7))


@dataclass
class Span:
    """A duration: whole months and seconds with its sign, and digits of a
    fraction that is added, so ``-PT0.25S`` is -1 second and .75.  ``seconds`` and
    ``months`` are null where a component is too long."""

    months: Column
    seconds: Column
    fraction: Column


def span(c: Column, wide: bool) -> Span:
    kind = COMPONENT if wide else "long"

    def part(text: Column, letter: str) -> Column:
        found = F.regexp_extract(text, f"([0-9]+)(?:\\.[0-9]+)?{letter}", 1)
        return F.when(found == "", F.lit(0).cast(kind)).otherwise(found.try_cast(kind))

    date = F.substring_index(c, "T", 1)
    clock = F.when(F.instr(c, "T") > 0, F.substring_index(c, "T", -1)).otherwise("")
    f = F.rtrim(F.regexp_extract(clock, r"\.([0-9]+)S", 1), F.lit("0"))
    months = part(date, "Y") * 12 + part(date, "M")
    seconds = part(date, "D") * 86400 + part(clock, "H") * 3600 + part(clock, "M") * 60 + part(clock, "S")
    if wide:
        months, seconds = months.cast(WIDE), seconds.cast(WIDE)
    minus = c.startswith("-")
    # one less, and what is missing from the fraction to one
    rest = F.concat(F.translate(F.substr(f, F.lit(1), F.length(f) - 1), "0123456789", "9876543210"), F.translate(F.substr(f, F.length(f)), "123456789", "987654321"))
    below = F.when(f != "", F.lit(1)).otherwise(F.lit(0))
    return Span(F.when(minus, -months).otherwise(months), F.when(minus, -seconds - below).otherwise(seconds), F.when(minus & (f != ""), rest).otherwise(f))


def spanned(c: Column, body: Callable[[Span], Column]) -> Column:
    """An expression over a duration's parts, each taken from it once: in 64 bits
    where they are sure to fit."""

    def of(wide: bool) -> Column:
        s = span(c, wide)
        return let(F.struct(s.months.alias("m"), s.seconds.alias("s"), s.fraction.alias("f")), lambda v: body(Span(v["m"], v["s"], v["f"])))

    return F.when(F.length(c) <= SHORT, of(False)).otherwise(of(True))


def _from_start(months: Column, seconds: Column, start: tuple[int, int]) -> Column:
    """Whole seconds from a start month to the end of a duration; null where the
    months are too many for the calendar."""
    near = F.when(F.abs(months) < 10**13, months.cast("long"))
    index = F.lit(start[0] * 12 + start[1] - 1).cast("long") + near
    y, m = _div(index, 12), F.pmod(index, F.lit(12)) + 1
    days = days_from_civil(y, m, F.lit(1).cast("long")) - F.lit(int(_start(start)) // 86400)
    return days.cast(COMPONENT) * F.lit(86400) + seconds


def _agreed(ways: list[Column]) -> Column:
    """What all four comparisons say, or null."""
    return let(F.array(*ways), lambda s: F.when(F.array_min(s) == F.array_max(s), F.when(F.exists(s, lambda x: x.isNull()), F.lit(None).cast("int")).otherwise(F.get(s, 0))))


def compare_durations(a: Column, b: Column | str) -> Column:
    """-1, 0 or 1 where all four start months agree, else null."""

    def way(x: Span, months, w, f) -> Column:
        """``w`` are the seconds of the other side by start, or alone."""
        direct = in_order(x.seconds, x.fraction, w(None), f)
        return F.when(x.months == months, direct).otherwise(_agreed([in_order(_from_start(x.months, x.seconds, s), x.fraction, w(s), f) for s in _STARTS]))

    if isinstance(b, str):
        m, exact = duration_of(b)
        whole = int(exact.to_integral_value(ROUND_FLOOR))
        f = F.lit(f"{exact - whole:f}".partition(".")[2].rstrip("0"))
        number = lambda n: F.lit(n) if abs(n) < 1 << 62 else F.lit(Decimal(n)).cast(WIDE)
        ends = {s: int(_seconds_from(s, m)) + whole for s in _STARTS}
        low, high = min(ends.values()), max(ends.values())

        def const(x: Span) -> Column:
            plain = F.when(in_order(x.seconds, x.fraction, number(low), f) < 0, -1).when(in_order(x.seconds, x.fraction, number(high), f) > 0, 1)
            if low == high:
                plain = F.when(x.seconds.isNotNull(), F.coalesce(plain, F.lit(0)))
            return F.when(x.months == 0, plain).otherwise(way(x, F.lit(m), lambda s: number(whole if s is None else ends[s]), f))

        return spanned(a, const)
    second = spanned(b, lambda y: F.struct(y.months.cast(WIDE).alias("m"), y.seconds.cast(WIDE).alias("s"), y.fraction.alias("f")))
    return let(second, lambda v: spanned(a, lambda x: way(x, v["m"], lambda s: v["s"] if s is None else _from_start(v["m"], v["s"], s), v["f"])))


def duration_canonical(c: Column, kind: str) -> Column:
    return spanned(c, lambda v: _duration_text(v, kind))


def _duration_text(v: Span, kind: str) -> Column:
    negative = (v.months < 0) | (v.seconds < 0)
    under = negative & (v.fraction != "")  # the fraction was added to one second less
    m, s = F.abs(v.months), F.abs(v.seconds) - F.when(under, F.lit(1)).otherwise(F.lit(0))
    f = v.fraction
    rest = F.concat(F.translate(F.substr(f, F.lit(1), F.length(f) - 1), "0123456789", "9876543210"), F.translate(F.substr(f, F.length(f)), "123456789", "987654321"))
    f = F.when(under, rest).otherwise(f)
    part = lambda n, b: (n - F.pmod(n, F.lit(b))) / F.lit(b)  # noqa: E731 (no remainder: exact)
    whole = lambda n: F.regexp_replace(n.cast(WIDE).cast("string"), r"\..*$", "")
    day = F.pmod(s, F.lit(86400)).cast("long")
    hours, minutes, secs = _div(day, 3600), F.pmod(_div(day, 60), F.lit(60)), F.pmod(day, F.lit(60))
    unit = lambda n, u: F.when(n > 0, F.concat(whole(n), F.lit(u))).otherwise("")
    clock = F.concat(unit(hours, "H"), unit(minutes, "M"), F.when((secs > 0) | (f != ""), F.concat(secs.cast("string"), F.when(f != "", F.concat(F.lit("."), f)).otherwise(""), F.lit("S"))).otherwise(""))
    text = F.concat(unit(part(m, 12), "Y"), unit(F.pmod(m, F.lit(12)), "M"), unit(part(s, 86400), "D"), F.when(clock != "", F.concat(F.lit("T"), clock)).otherwise(""))
    full = F.concat(F.when(negative, "-").otherwise(""), F.lit("P"), text)
    zero = F.lit(None).cast("string") if kind == "yearMonthDuration" else F.lit("PT0S")
    return F.when((m == 0) & (v.seconds == 0) & (v.fraction == ""), zero).otherwise(full)


# binary, names ---------------------------------------------------------------


def octets(c: Column, kind: str) -> Column:
    if kind == "hexBinary":
        return (F.length(c) / 2).cast("int")
    tight = F.regexp_replace(c, " ", "")
    return (F.length(tight) / 4 * 3).cast("int") - (F.length(tight) - F.length(F.regexp_replace(tight, "=", "")))


def resolve_qname(c: Column, bindings: Column | None) -> tuple[Column, Column]:
    """(namespace, local); the namespace is null where the prefix is unbound and
    empty where no default is in scope."""
    prefix = F.when(F.instr(c, ":") > 0, F.substring_index(c, ":", 1)).otherwise("")
    local = F.substring_index(c, ":", -1)
    if bindings is None:
        return F.when(prefix == "", F.lit("")), local
    found = F.try_element_at(bindings, prefix)
    return F.when(prefix == "", F.coalesce(found, F.lit(""))).otherwise(F.when(found != "", found)), local


# the registry ----------------------------------------------------------------


@dataclass(frozen=True)
class Mapping:
    """What a datatype can do, as functions of columns; ``None`` leaves a part
    to the engine."""

    ok: Callable[[Column], Column] | None = None
    canonical: Callable[[Column], Column] | None = None
    eq_key: Callable[[Column], Column] | None = None
    compare: Callable[[Column, Column], Column] | None = None


#: Mappings that replace the engine's own, by type name.
CUSTOM: dict[str, Mapping] = {}


def override(base: dict[str, Mapping], partial: dict[str, Mapping]) -> dict[str, Mapping]:
    """Mappings of ``partial`` first, part by part, then those of ``base``."""
    out = dict(base)
    for name, m in partial.items():
        old = base.get(name, Mapping())
        out[name] = Mapping(*[getattr(m, f) or getattr(old, f) for f in ("ok", "canonical", "eq_key", "compare")])
    return out


def _custom(kind: str, part: str):
    return getattr(CUSTOM[kind], part) if kind in CUSTOM else None


def ok(c: Column, kind: str, bindings: Column | None = None) -> Column:
    """Is a normalised literal in the lexical space?"""
    if own := _custom(kind, "ok"):
        return own(c)
    if kind in ("string", "anyURI"):
        return c.isNotNull()
    if kind in TIMES:
        return moment_ok(c, kind)
    if kind in ("QName", "NOTATION"):
        return c.rlike(_QNAME) & resolve_qname(c, bindings)[0].isNotNull()
    return c.rlike(LEXICAL[kind])


def canonical(c: Column, kind: str) -> Column:
    """The canonical form of a literal in the lexical space; null where there is
    none."""
    if own := _custom(kind, "canonical"):
        return own(c)
    if kind in ("string", "anyURI"):
        return c
    if kind == "boolean":
        return F.when(c.isin("true", "1"), "true").otherwise("false")
    if kind == "decimal":
        return decimal_canonical(c)
    if kind in ("float", "double"):
        return floating_canonical(c, kind)
    if kind == "precisionDecimal":
        return precision_canonical(c)
    if kind in DURATIONS:
        return duration_canonical(c, kind)
    if kind in TIMES:
        return moment_canonical(c, kind)
    if kind == "hexBinary":
        return F.upper(c)
    if kind == "base64Binary":
        return F.regexp_replace(c, " ", "")
    return F.lit(None).cast("string")


def eq_key(c: Column, kind: str, bindings: Column | None = None) -> Column:
    """Equal values have equal keys; null for what equals nothing (NaN)."""
    if own := _custom(kind, "eq_key"):
        return own(c)
    if kind in ("float", "double"):
        v = floating(c, kind)
        return F.when(c == "NaN", F.lit(None).cast("string")).otherwise(F.when(v == 0, F.lit("0")).otherwise(floating_canonical(c, kind)))
    if kind == "precisionDecimal":
        return precision_key(c)
    if kind in TIMES:
        whole = lambda m: m.both_ways(lambda w: w.cast(WIDE).cast("string"))
        return bound(c, kind, lambda m: F.concat(F.when(m.zone.isNull(), "L").otherwise("U"), whole(m), F.lit("."), m.fraction))
    if kind in DURATIONS:
        return spanned(c, lambda v: F.concat(v.months.cast("string"), F.lit("|"), v.seconds.cast("string"), F.lit("."), v.fraction))
    if kind in ("QName", "NOTATION"):
        ns, local = resolve_qname(c, bindings)
        return F.concat(F.lit(kind + "{"), ns, F.lit("}"), local)
    return canonical(c, kind)


def compare(a: Column, b: Column | str, kind: str) -> Column:
    """-1, 0, 1, or null for incomparable, of two literals in the space.  A
    constant given as text is worked out once, here."""
    if own := _custom(kind, "compare"):
        return own(a, F.lit(b) if isinstance(b, str) else b)
    way = lambda x, y: F.when(x < y, -1).when(x > y, 1).when(x == y, 0)
    if isinstance(b, str):
        return _compare_constant(a, b, kind, way)
    if kind in ("decimal", "precisionDecimal"):
        f: Callable = decimal_key if kind == "decimal" else precision_key
        return let(f(a), lambda x: let(f(b), lambda y: way(x, y)))
    if kind in ("float", "double"):
        x, y = floating(a, kind), floating(b, kind)
        return F.when((a == "NaN") | (b == "NaN"), F.lit(None).cast("int")).otherwise(way(x, y))
    if kind in DURATIONS:
        return compare_durations(a, b)
    if kind in TIMES:
        return compare_moments(a, b, kind)
    raise ValueError(f"{kind} has no order")


def _compare_constant(a: Column, text: str, kind: str, way: Callable) -> Column:
    if kind == "decimal":
        exact = Decimal(text)
        slow = way(decimal_key(a), F.lit(key_of(exact)))
        if len(text) > 18:
            return slow
        # short literals are exact in 38 digits, of which 18 after the point
        fast = way(a.try_cast("decimal(38,18)"), F.lit(exact).cast("decimal(38,18)"))
        return F.when(F.length(a) <= 18, fast).otherwise(slow)
    if kind in DURATIONS:
        return compare_durations(a, text)
    if kind in TIMES:
        return compare_moments(a, text, kind)
    return compare(a, F.lit(text), kind)


# the same for constants -------------------------------------------------------


def key_of(x: Decimal) -> str:
    """``decimal_key`` of a number."""
    sign, digits, exp = x.as_tuple()
    text = "".join(map(str, digits))
    text = text + "0" * exp if exp >= 0 else text.rjust(1 - exp, "0")
    whole, part = (text, "") if exp >= 0 else (text[:exp], text[exp:])
    whole, part = whole.lstrip("0"), part.rstrip("0")
    digits_ = whole or "0"
    tail = f"{len(digits_):010d}{digits_}.{part}"
    if sign and (whole or part):
        return "0" + tail.translate(str.maketrans("0123456789", "9876543210")) + "~"
    return "1" + tail


def duration_of(text: str) -> tuple[int, Decimal]:
    m = re.fullmatch(r"(-?)P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?", text)
    if not m:
        raise ValueError(f"{text} is no duration")
    y, mo, d, h, mi = (int(x or 0) for x in m.groups()[1:6])
    sign = -1 if m[1] else 1
    return sign * (12 * y + mo), sign * (Decimal(86400 * d + 3600 * h + 60 * mi) + Decimal(m[7] or 0))


def moment_of(text: str, kind: str) -> tuple[int, str, bool]:
    """(whole seconds, digits of the fraction, zoned) of a calendar literal."""
    kind = "dateTime" if kind == "dateTimeStamp" else kind
    if not re.fullmatch(LEXICAL[kind].replace(r"\A", "").replace(r"\z", ""), text):
        raise ValueError(f"{text} is no {kind}")
    zone = re.search(r"(Z|[+-]\d\d:\d\d)$", text)
    body = text[: zone.start()] if zone else text
    offset = 0 if not zone or zone[0] == "Z" else (-1 if zone[0][0] == "-" else 1) * (int(zone[0][1:3]) * 60 + int(zone[0][4:6]))
    date, _, clock = ("1972-12-31", "", body) if kind == "time" else body.partition("T")
    y, m, d = 1972, 12, 31
    if kind in ("gMonthDay", "gMonth", "gDay"):
        digits = date.lstrip("-")
        m = int(digits[:2]) if kind != "gDay" else m
        d = int(digits[-2:]) if kind != "gMonth" else d
    else:
        minus, digits = date.startswith("-"), date.lstrip("-").split("-")
        y = -int(digits[0]) if minus else int(digits[0])
        m = int(digits[1]) if len(digits) > 1 else m
        d = int(digits[2]) if len(digits) > 2 else d
    if kind in ("gYearMonth", "gMonth"):
        d = 30 if m in (4, 6, 9, 11) else 31 if m != 2 else 29 if (y % 4 == 0 and y % 100 != 0) or y % 400 == 0 else 28
    h, mi, sec = clock.split(":") if clock else ("0", "0", "0")
    whole, _, fraction = sec.partition(".")
    seconds = (_days(y, m) + d - 1) * 86400 + int(h) * 3600 + int(mi) * 60 + int(whole) - offset * 60
    return seconds - (86400 if kind == "time" and h == "24" else 0), fraction.rstrip("0"), bool(zone)


def _days(y: int, m: int) -> int:
    y -= m <= 2
    return 365 * y + y // 4 - y // 100 + y // 400 + (153 * ((m + 9) % 12) + 2) // 5 - 719468


def _start(start: tuple[int, int]) -> Decimal:
    return Decimal(86400 * _days(*start))


def _seconds_from(start: tuple[int, int], months: int) -> Decimal:
    """Seconds of so many months from a start month."""
    index = start[0] * 12 + start[1] - 1 + months
    return Decimal(86400 * _days(index // 12, index % 12 + 1)) - _start(start)


def order_of(a: str, b: str, kind: str) -> int | None:
    """-1, 0 or 1 of two literals in the space, as ``compare`` says of columns;
    null where they are incomparable."""
    way = lambda x, y: (x > y) - (x < y)
    if kind == "decimal":
        return way(Decimal(a), Decimal(b))
    if kind in ("float", "double", "precisionDecimal"):
        if "NaN" in (a, b):
            return None
        number = Decimal if kind == "precisionDecimal" else float
        return way(number(a), number(b))
    if kind in DURATIONS:
        (m, s), (m2, s2) = duration_of(a), duration_of(b)
        found = {way(_seconds_from(x, m) + s, _seconds_from(x, m2) + s2) for x in _STARTS}
        return found.pop() if len(found) == 1 else None
    (w, f, z), (w2, f2, z2) = moment_of(a, kind), moment_of(b, kind)
    if z == z2:
        return way((w, f), (w2, f2))
    return -1 if (w + 50400, f) < (w2, f2) else 1 if (w - 50400, f) > (w2, f2) else None
