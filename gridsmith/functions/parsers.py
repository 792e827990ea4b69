"""Parser factories. Each compiles to expressions that never throw; a failed cell has a message and a null value."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import replace
from datetime import date as Date
from datetime import datetime as DateTime
from decimal import Decimal
from enum import Enum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import strptime
from .parsed import NO_ERROR, CellColumns, ParsedExpr, Parser, as_text, fail_null, fail_unless, let, quoted, type_of

# The characters that Unicode calls white space; Python strips the four ASCII separators too, but not around numbers.
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SEPARATORS = "\x1c\x1d\x1e\x1f"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES + SEPARATORS))


def bare(c: Column) -> Column:
    """Text of a number without outer white space; numbers allow none of the ASCII separators."""
    return F.btrim(c, F.lit(SPACES))


def _stripped(c: Column, on: bool) -> Column:
    return strip(c) if on else c


def string(*, strip: bool = False, lower: bool = False, upper: bool = False) -> Parser:
    """Text, stripped, then in lower or upper case."""
    if lower and upper:
        raise ValueError("lower and upper exclude each other")
    trim = strip

    def build(c, dtype, cell):
        c = _stripped(as_text(c, dtype), trim)
        return ParsedExpr(F.lower(c) if lower else F.upper(c) if upper else c, NO_ERROR(), T.StringType(), sure=True)

    return Parser("string", build, f"string(strip={trim}, lower={lower}, upper={upper})")


def integer(*, base: int = 10) -> Parser:
    """Whole numbers as int() reads them: outer white space, sign, single underscores, a base's prefix. 64 bits; ASCII digits."""
    if isinstance(base, bool) or not isinstance(base, int) or not (base == 0 or 2 <= base <= 36):
        raise ValueError("base must be 0 or from 2 to 36")
    long = T.LongType()

    def in_base(t: Column, b: int, prefix: str) -> tuple[Column, Column]:
        low, high = "0123456789abcdefghijklmnopqrstuvwxyz"[:b], "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[:b]
        digit = f"[{re.escape(low)}{re.escape(high)}]"
        ok = t.rlike(f"\\A[+-]?{prefix}{digit}+(_{digit}+)*\\z")
        if b == 10:
            return ok, F.replace(t, F.lit("_"), F.lit("")).try_cast("bigint")
        digits = F.replace(F.regexp_replace(t, f"\\A[+-]?{prefix}", ""), F.lit("_"), F.lit(""))
        # conv works with 64 bits and saturates, so values beyond 63 bits are told by the decimal.
        value = F.conv(digits, b, 10).try_cast("decimal(20,0)")
        short = F.length(F.ltrim(digits, F.lit("0"))) <= int(64 / (b.bit_length() - 1)) + 1
        return ok, F.when(short, F.when(t.startswith("-"), -value).otherwise(value)).try_cast("bigint")

    def build(c, dtype, cell):
        c = as_text(c, dtype)
        t = let(cell, bare(c))
        prefixed = {2: "(?:0[bB]_?)?", 8: "(?:0[oO]_?)?", 16: "(?:0[xX]_?)?"}
        if base:
            forms = [in_base(t, base, prefixed.get(base, ""))]
        else:
            forms = [in_base(t, b, p) for b, p in ((2, "0[bB]_?"), (8, "0[oO]_?"), (16, "0[xX]_?"))]
            ten_ok, ten = in_base(t, 10, "")
            forms.append((ten_ok & t.rlike("\\A[+-]?([1-9].*|0[0_]*)\\z"), ten))
        value = F.coalesce(*(F.when(ok, v) for ok, v in forms))
        return fail_null(value, F.concat(F.lit(f"invalid literal for int() with base {base}: "), quoted(c)), long, c, cell)

    return Parser("integer", build, f"integer(base={base})", kind=long)


FLOAT = r"(?i)\A[+-]?(?:nan|inf|infinity|(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:e[+-]?[0-9]+(?:_[0-9]+)*)?)\z"


def floating() -> Parser:
    """Numbers as float() reads them, nan and infinities included."""

    def build(c, dtype, cell):
        c = as_text(c, dtype)
        t = let(cell, bare(c))
        value = F.when(t.rlike(FLOAT), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))
        return fail_null(value, F.concat(F.lit("could not convert string to float: "), quoted(c)), T.DoubleType(), c, cell)

    return Parser("floating", build, "floating()", kind=T.DoubleType())


def decimal(precision: int = 38, scale: int = 18) -> Parser:
    """Exact decimals; a number that the type can't hold exactly fails, as do NaN and infinities."""
    if not 1 <= precision <= 38 or not 0 <= scale <= precision:
        raise ValueError("precision must be from 1 to 38 and scale from 0 to precision")
    kind = T.DecimalType(precision, scale)
    number = r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]{1,4})?\z"

    def build(c, dtype, cell):
        c = as_text(c, dtype)
        t = let(cell, F.replace(bare(c), F.lit("_"), F.lit("")))
        # Digits behind the point, without zeros at the end, less the power of ten; of a whole number, its zeros count backwards.
        mantissa = F.substring_index(F.lower(t), "e", 1)
        power = F.when(F.contains(F.lower(t), F.lit("e")), F.substring_index(F.lower(t), "e", -1).try_cast("int")).otherwise(0)
        fraction = F.when(F.contains(mantissa, F.lit(".")), F.rtrim(F.substring_index(mantissa, ".", -1), F.lit("0"))).otherwise("")
        whole = F.substring_index(mantissa, ".", 1)
        places = F.when(fraction != "", F.length(fraction)).otherwise(F.length(F.rtrim(whole, F.lit("0"))) - F.length(whole)) - power
        value = F.when(t.rlike(number) & (places <= scale), t.try_cast(kind))
        return fail_null(value, F.concat(F.lit("not an exact decimal: "), quoted(c)), kind, c, cell)

    return Parser("decimal", build, f"decimal({precision}, {scale})", kind=kind)


def _temporal_format(format: Any) -> str:
    if not isinstance(format, str):
        raise TypeError("format must be a string")
    if not format:
        raise ValueError("format must not be empty")
    return format


def date(*, format: str = "%Y-%m-%d") -> Parser:
    """A date in one strptime format, matched as a whole."""
    form = _temporal_format(format)
    if (read := strptime.compile(form)) is None:
        return custom(lambda text, cell: DateTime.strptime(text, form).date(), returns=T.DateType(), name=f"date(format={form!r})")

    def build(c, dtype, cell):
        c = as_text(c, dtype)
        value = read(c, strptime.to_date)
        return fail_null(value, F.concat(F.lit("time data "), quoted(c), F.lit(f" does not match format {form!r}")), T.DateType(), c, cell)

    return Parser("date", build, f"date(format={form!r})", kind=T.DateType())


def datetime(*, format: str = "%Y-%m-%dT%H:%M:%S") -> Parser:
    """A date and time in one strptime format: without %z a local time, with it an instant."""
    form = _temporal_format(format)
    aware = "%z" in form.replace("%%", "")
    kind = T.TimestampType() if aware else T.TimestampNTZType()
    if (read := strptime.compile(form)) is None:
        return custom(lambda text, cell: DateTime.strptime(text, form), returns=kind, name=f"datetime(format={form!r})")

    def build(c, dtype, cell):
        c = as_text(c, dtype)
        value = read(c, strptime.to_instant if aware else strptime.to_local)
        return fail_null(value, F.concat(F.lit("time data "), quoted(c), F.lit(f" does not match format {form!r}")), kind, c, cell)

    return Parser("datetime", build, f"datetime(format={form!r})", kind=kind)


def _tokens(values: Any, name: str, fold: bool) -> list[str]:
    if isinstance(values, str):
        raise TypeError(f"{name} must be a collection of strings, not one string")
    values = list(values)
    if not all(isinstance(v, str) for v in values):
        raise TypeError(f"{name} must hold strings only")
    return [v.lower() if fold else v for v in values]


def boolean(*, true_values: Any = ("true",), false_values: Any = ("false",), case_sensitive: bool = False) -> Parser:
    """A closed vocabulary; nothing else is true or false, and white space counts."""
    yes, no = _tokens(true_values, "true_values", not case_sensitive), _tokens(false_values, "false_values", not case_sensitive)
    if not yes or not no:
        raise ValueError("true_values and false_values must not be empty")
    if both := sorted(set(yes) & set(no)):
        raise ValueError(f"tokens are both true and false: {both}")
    expected = sorted({*yes, *no})

    def build(c, dtype, cell):
        c = as_text(c, dtype)
        t = c if case_sensitive else F.lower(c)
        value = F.when(t.isin(yes), True).when(t.isin(no), False)
        return fail_null(value, F.lit(f"Expected one of {expected}"), T.BooleanType(), c, cell)

    return Parser("boolean", build, f"boolean(true_values={sorted(set(yes))}, false_values={sorted(set(no))}, case_sensitive={case_sensitive})", kind=T.BooleanType())


def _lookup(t: Column, table: Mapping[str, Any], dtype: T.DataType) -> tuple[Column, Column]:
    """(found, value) of text in a literal table."""
    keys = list(table)
    if not keys:
        return F.lit(False), F.lit(None).cast(dtype)
    pairs = [x for k in keys for x in (F.lit(k), F.lit(table[k]).cast(dtype))]
    return t.isin(keys), F.try_element_at(F.create_map(*pairs), t)


def choice(*values: str, case_sensitive: bool = True) -> Parser:
    """One of the values, in its declared spelling."""
    if not values:
        raise ValueError("choice needs at least one value")
    if not all(isinstance(v, str) for v in values):
        raise TypeError("choices must be strings")
    table = {(v if case_sensitive else v.lower()): v for v in reversed(values)}

    def build(c, dtype, cell):
        c = as_text(c, dtype)
        _, value = _lookup(c if case_sensitive else F.lower(c), table, T.StringType())
        return fail_null(value, F.lit(f"Expected one of {list(values)}"), T.StringType(), c, cell)

    return Parser("choice", build, f"choice({', '.join(map(repr, values))}, case_sensitive={case_sensitive})")


def literal_regex(text: str) -> str:
    """A regular expression of literal text; Java splits by a single escaped sign without compiling one."""
    if len(text) == 1 and text.isascii():
        return text if text.isalnum() else "\\" + text
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def split(separator: str = ",", *, strip_items: bool = True, keep_empty: bool = False) -> Parser:
    """A list of the parts between a literal separator."""
    if not isinstance(separator, str) or not separator:
        raise ValueError("separator must be a string that isn't empty")
    regex = literal_regex(separator)

    def build(c, dtype, cell):
        parts = F.split(as_text(c, dtype), regex, -1)
        if strip_items:
            parts = F.transform(parts, strip)
        if not keep_empty:
            parts = F.filter(parts, lambda x: x != "")
        return ParsedExpr(parts, NO_ERROR(), T.ArrayType(T.StringType()), sure=True)

    return Parser("split", build, f"split({separator!r}, strip_items={strip_items}, keep_empty={keep_empty})", decode=lambda v: None if v is None else list(v), kind=T.ArrayType(T.StringType()))


def spark_type(values: Any) -> T.DataType:
    """The one Spark type of Python values; None fits any."""
    kinds = {type(v) for v in values if v is not None}
    known = {str: T.StringType(), bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), Date: T.DateType(), DateTime: T.TimestampNTZType(), Decimal: T.DecimalType(38, 18)}
    if len(kinds) > 1 or not kinds <= set(known):
        raise TypeError(f"values must be of one plain type, not {sorted(k.__name__ for k in kinds)}")
    return known[kinds.pop()] if kinds else T.StringType()


def map_value(values: Mapping[str, Any], *, case_sensitive: bool = True) -> Parser:
    """The value that the text is mapped to; of keys that differ by case only, the last counts if case doesn't."""
    if not isinstance(values, Mapping) or not values:
        raise ValueError("map_value needs a mapping that isn't empty")
    if not all(isinstance(k, str) for k in values):
        raise TypeError("keys must be strings")
    kind = spark_type(values.values())
    table = {(k if case_sensitive else k.lower()): v for k, v in values.items()}

    def build(c, dtype, cell):
        c = as_text(c, dtype)
        ok, value = _lookup(c if case_sensitive else F.lower(c), table, kind)
        return fail_unless(ok, value, F.concat(F.lit("No mapped value for "), quoted(c)), kind, c, cell)

    return Parser("map_value", build, f"map_value({dict(values)!r}, case_sensitive={case_sensitive})", kind=kind)


def to_parser(p: Any) -> Parser:
    if isinstance(p, Parser):
        return p
    if hasattr(p, "as_parser"):
        return p.as_parser()
    if callable(p):
        return custom(p)
    raise TypeError(f"not a parser: {p!r}")


def compose(*parsers: Any) -> Parser:
    """Parsers in turn, each given what the one before returned; the first error counts."""
    if not parsers:
        raise ValueError("compose needs at least one parser")
    steps = [to_parser(p) for p in parsers]

    def build(c, dtype, cell):
        out = steps[0].apply(c, dtype, cell)
        error, code, bad, sure = out.error, out.code, out.failed, out.sure
        for p in steps[1:]:
            nxt = p.apply(let(cell, out.value), out.dtype, cell)
            code = nxt.code if code is None else code if nxt.code is None else F.coalesce(code, nxt.code)
            error, bad, sure = F.coalesce(error, nxt.error), bad | nxt.failed, sure and nxt.sure
            out = nxt
        return ParsedExpr(out.value if sure else F.when(~bad, out.value), error, out.dtype, code, bad, sure)

    def kind(dtype):
        for p in steps:
            dtype = p.out(dtype)
        return dtype

    return Parser("compose", build, f"compose({', '.join(p.description or p.name for p in steps)})", decode=steps[-1].decode, native=all(p.native for p in steps), kind=kind)


class _Named(Exception):
    """Carries an expression that a parser of items wants to be computed once."""

    def __init__(self, c: Column):
        super().__init__()
        self.c = c


def each_item(inner: Parser, items: Column, kind: T.DataType, out: T.DataType, cell: CellColumns | None) -> ParsedExpr:
    """inner for every item, in one expression over the list, however often it is copied.

    What inner uses more than once is added to the items, which are structs, step by step: each step sees the ones before in its own item.
    """
    named: list[str] = []
    sure = False

    def attempt(s: Column) -> ParsedExpr:
        used = 0

        def bind(c: Column) -> Column:
            nonlocal used
            used += 1
            if used > len(named):
                raise _Named(c)
            return s[named[used - 1]]

        place = replace(cell if cell is not None else CellColumns("", "", *[F.lit(None)] * 5), bind=bind)
        return inner.apply(s["x"], kind, place)

    def step(s: Column) -> Column:
        nonlocal sure, done
        try:
            got = attempt(s)
        except _Named as e:
            done = False
            return F.struct(*(s[n].alias(n) for n in ["x", *named]), e.c.alias(f"b{len(named)}"))
        sure = got.sure
        return got.value if sure else F.struct(got.value.alias("value"), got.error.alias("error"))

    made, done = F.transform(items, lambda x: F.struct(x.alias("x"))), False
    while not done:
        done = True
        made = F.transform(made, step)
        if not done:
            named.append(f"b{len(named)}")
    made = let(cell, made)
    if sure:
        return ParsedExpr(made, NO_ERROR(), out, sure=True)
    error = let(cell, F.get(F.filter(F.transform(made, lambda x: x["error"]), lambda e: e.isNotNull()), F.lit(0)))
    return ParsedExpr(F.when(error.isNull(), F.transform(made, lambda x: x["value"])), error, out)


def each(parser: Any) -> Parser:
    """A parser for every item of a list; the first item that fails is reported."""
    inner = to_parser(parser)

    def kind(dtype):
        return T.ArrayType(inner.out(dtype.elementType if isinstance(dtype, T.ArrayType) else T.StringType()))

    def build(c, dtype, cell):
        out = kind(dtype)
        if not isinstance(dtype, T.ArrayType):
            return ParsedExpr(F.lit(None).cast(out), F.when(c.isNotNull(), F.lit("each() needs a list of items")), out)
        if inner.function is not None:
            # One call of Python for a list, in the same Arrow batches as other cells.
            one = inner.function
            return custom(lambda items, context: [one(x, context) for x in items], returns=out).apply(c, dtype, cell)
        if not inner.native:
            raise TypeError("each() over a parser with a Python part: make it one custom parser")
        return each_item(inner, c, dtype.elementType, out, cell)

    return Parser("each", build, f"each({inner.description or inner.name})", decode=(lambda v: None if v is None else [inner.decode(x) for x in v]) if inner.decode else list, native=inner.native, kind=kind)


def optional(parser: Any, *, none_values: Any = ("none", "null"), case_sensitive: bool = False) -> Parser:
    """Null for blank text or a token, else the inner parser."""
    inner, tokens = to_parser(parser), _tokens(none_values, "none_values", not case_sensitive)

    def build(c, dtype, cell):
        t = as_text(c, dtype)
        none = t.isNull() | (t == "") | ((t if case_sensitive else F.lower(t)).isin(tokens) if tokens else F.lit(False))
        got = inner.apply(c, dtype, cell)
        none = let(cell, none)
        return ParsedExpr(F.when(~none, got.value), F.when(~none, got.error), got.dtype, got.code, ~none & got.failed)

    return Parser("optional", build, f"optional({inner.description or inner.name}, none_values={sorted(set(tokens))}, case_sensitive={case_sensitive})", decode=inner.decode, native=inner.native, kind=inner.out)


def enum(kind: type[Enum]) -> Parser:
    """A member by the text of its value or by its name, the first in order of members; columns hold the member's name."""
    table: dict[str, str] = {}
    for m in kind:
        table.setdefault(str(m.value), m.name)
        table.setdefault(m.name, m.name)
    # A member before another wins, be it by value or by name.
    names = [m.name for m in kind]

    def build(c, dtype, cell):
        c = as_text(c, dtype)
        _, value = _lookup(c, table, T.StringType())
        return fail_null(value, F.concat(F.lit(f"Expected one of {names}, got "), quoted(c)), T.StringType(), c, cell)

    return Parser("enum", build, f"enum({kind.__name__})", decode=lambda v: None if v is None else kind[v])


def literal(*values: str) -> Parser:
    """Exactly one of the values."""
    return Parser("literal", choice(*values).build, f"literal({', '.join(map(repr, values))})")


def identity() -> Parser:
    return Parser("identity", lambda c, dtype, cell: ParsedExpr(c, NO_ERROR(), dtype, sure=True), "identity()", kind=lambda dtype: dtype)


def custom(function: Callable[..., Any], *, returns: T.DataType | str = "string", name: str | None = None, batch: bool = False) -> Parser:
    """A Python function (value, CellContext) as a parser, in Arrow batches; returns is the type of its results.

    An exception fails the cell with its text; a TableError keeps its message and code. With batch=True the function is called once for
    each batch, with a pandas Series of texts, and gives as many values; an exception among them fails its cell.
    """
    kind = type_of(returns)

    def build(c, dtype, cell):
        if cell is None:
            return ParsedExpr(F.lit(None).cast(kind), NO_ERROR(), kind)
        from ..hooks import batch_udf, cell_udf

        if batch:
            got = let(cell, batch_udf(function, kind, cell)(as_text(c, dtype)))
            return ParsedExpr(got["value"], got["error"], kind, got["code"])
        got = cell_udf(function, kind, cell)(F.struct(c.alias("value"), cell.row.alias("row"), cell.column.alias("column"), cell.item_id.alias("item_id"), cell.source_value.alias("source_value"), cell.source_uri.alias("source_uri")))
        got = let(cell, F.when(c.isNotNull(), got))
        return ParsedExpr(got["value"], got["error"], kind, got["code"])

    return Parser(name or getattr(function, "__qualname__", type(function).__qualname__), build, name or getattr(function, "__qualname__", type(function).__qualname__), native=False, function=None if batch else function, kind=kind)
