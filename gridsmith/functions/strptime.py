"""strptime formats as one regular expression and columns built of its groups."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .parsed import once

# What Python's strptime accepts for each directive.
DIRECTIVES = {
    "d": r"3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9]",
    "m": r"1[0-2]|0[1-9]|[1-9]",
    "Y": r"[0-9]{4}",
    "y": r"[0-9]{2}",
    "H": r"2[0-3]|[01][0-9]|[0-9]",
    "I": r"1[0-2]|0[1-9]|[1-9]| [1-9]",
    "M": r"[0-5][0-9]|[0-9]",
    "S": r"6[01]|[0-5][0-9]|[0-9]",
    "f": r"[0-9]{1,6}",
    "p": r"am|pm",
    "b": r"jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec",
    "B": r"january|february|march|april|may|june|july|august|september|october|november|december",
    "j": r"36[0-6]|3[0-5][0-9]|[12][0-9][0-9]|0[1-9][0-9]|00[1-9]|[1-9][0-9]|0[1-9]|[1-9]",
    "a": r"mon|tue|wed|thu|fri|sat|sun",
    "A": r"monday|tuesday|wednesday|thursday|friday|saturday|sunday",
    "z": r"[+-][0-9]{2}:?[0-5][0-9](?::?[0-5][0-9](?:\.[0-9]{1,6})?)?|(?-i:Z)",
}
SEPARATOR = "\x01"
Parts = dict[str, Column]


def compile(format: str) -> Callable[[Column, Callable[[Parts], Column]], Column] | None:
    """A function from text and what to make of its parts to that, null where it doesn't match; None if a directive is not known here."""
    pattern, names, i = "", [], 0
    while i < len(format):
        ch = format[i]
        if ch == "%":
            if i + 1 >= len(format):
                raise ValueError(f"stray % in format {format!r}")
            d = format[i + 1]
            i += 2
            if d == "%":
                pattern += "%"
            elif d not in DIRECTIVES or d in names:
                return None
            else:
                names.append(d)
                pattern += f"({DIRECTIVES[d]})"
        elif ch.isspace():
            while i < len(format) and format[i].isspace():
                i += 1
            pattern += r"\s+"
        else:
            pattern += re.escape(ch) if ch.isascii() else ch
            i += 1
    if "j" in names and ("m" in names or "d" in names):
        return None
    whole = f"(?i)\\A{pattern}\\z"

    def read(c: Column, make: Callable[[Parts], Column]) -> Column:
        # One replacement both matches and takes apart: only a text that matches has the separators afterwards.
        groups = "".join(f"{SEPARATOR}${k + 1}" for k in range(len(names))) or SEPARATOR
        pieces = F.split(F.regexp_replace(F.when(~F.contains(c, F.lit(SEPARATOR)), c), whole, groups), SEPARATOR)
        size = max(len(names), 1) + 1
        return once(pieces, lambda p: F.when(F.size(p) == size, make({n: F.get(p, F.lit(k + 1)) for k, n in enumerate(names)})))

    return read


def number(p: Parts, name: str, default: int) -> Column:
    return F.trim(p[name]).try_cast("int") if name in p else F.lit(default)


def year(p: Parts) -> Column:
    if "Y" in p:
        return number(p, "Y", 1900)
    if "y" in p:
        y = number(p, "y", 0)
        return F.when(y <= 68, y + 2000).otherwise(y + 1900)
    return F.lit(1900)


def month(p: Parts) -> Column:
    if "m" in p:
        return number(p, "m", 1)
    for d in ("B", "b"):
        if d in p:
            at = F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), F.lower(F.substring(p[d], 1, 3)))
            return F.floor((at - 1) / 3).cast("int") + 1
    return F.lit(1)


def to_date(p: Parts) -> Column:
    if "j" in p:
        # Day 366 of a shorter year is the next year's first, as it is for strptime.
        return once(year(p), lambda y: F.when(y >= 1, F.date_add(F.make_date(y, F.lit(1), F.lit(1)), number(p, "j", 1) - 1)))

    def valid(x: Column) -> Column:
        y, m, d = x["y"], x["m"], x["d"]
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
        return F.when((y >= 1) & (d <= last), F.make_date(y, m, d))

    return once(F.struct(year(p).alias("y"), month(p).alias("m"), number(p, "d", 1).alias("d")), valid)


def seconds(p: Parts) -> Column:
    """Microseconds since midnight; null for a leap second, which datetime can't hold."""
    hour = number(p, "H", 0)
    if "I" in p and "H" not in p:
        hour = number(p, "I", 12) % 12
        if "p" in p:
            hour = hour + F.when(F.lower(p["p"]) == "pm", 12).otherwise(0)
    s = number(p, "S", 0)
    micros = F.rpad(p["f"], 6, "0").try_cast("bigint") if "f" in p else F.lit(0).cast("bigint")
    return F.when(s < 60, ((hour * 3600 + number(p, "M", 0) * 60 + s).cast("bigint") * 1_000_000) + micros)


def micros_of(p: Parts) -> Column:
    """Microseconds since 1970 in the text's own zone."""
    return F.unix_date(to_date(p)).cast("bigint") * 86_400_000_000 + seconds(p)


def to_local(p: Parts) -> Column:
    # Microseconds added to a local time: no session zone takes part.
    return F.timestamp_add("MICROSECOND", micros_of(p), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def to_instant(p: Parts) -> Column:
    z = p["z"]
    # +hh:mm:ss or +hhmm; Z has no digits.
    digits = F.when(z != "Z", F.replace(F.substring(z, 2, 8), F.lit(":"), F.lit("")))
    part = lambda at: F.coalesce(F.substring(digits, at, 2).try_cast("int"), F.lit(0))
    offset = (part(1) * 3600 + part(3) * 60 + part(5)) * F.when(z.startswith("-"), -1).otherwise(1)
    return F.timestamp_micros(micros_of(p) - offset.cast("bigint") * 1_000_000)
