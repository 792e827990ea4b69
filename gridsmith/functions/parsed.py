"""ParsedExpr: a value column and an error column, and what parsers are made of."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ParsedExpr:
    """value is null wherever error is not; error is the observable message.

    bad, where it is given, says whether there is an error without the cost of its message.
    """

    value: Column
    error: Column
    dtype: T.DataType
    code: Column | None = None
    bad: Column | None = None
    #: Whether there is never an error.
    sure: bool = False

    @property
    def failed(self) -> Column:
        if self.sure:
            return F.lit(False)
        return self.error.isNotNull() if self.bad is None else self.bad


@dataclass(frozen=True)
class CellColumns:
    """Where a cell comes from, as columns, for parsers that report it or hand it to Python."""

    field: str
    label: str
    row: Column
    column: Column
    item_id: Column
    source_value: Column
    source_uri: Column
    user_data: Any = None
    #: Gives a name to an expression that is used more than once, so that it is computed once; see Binder.
    bind: Callable[[Column], Column] | None = None


class Binder:
    """Named expressions, in levels: those of one level are one projection, over the columns of the levels before.

    Catalyst doesn't fold a projection into the next where a column that isn't cheap is used more than once, so each is computed once.
    A chain is the expressions of one cell: each may use those before it, so the n-th of every chain is of level n.
    """

    def __init__(self, prefix: str):
        self.prefix = prefix
        self.levels: list[dict[str, Column]] = []
        self.made = 0

    def chain(self) -> Callable[[Column], Column]:
        depth = 0

        def bind(c: Column) -> Column:
            nonlocal depth
            if depth == len(self.levels):
                self.levels.append({})
            name = f"{self.prefix}{self.made}"
            self.levels[depth][name] = c
            depth, self.made = depth + 1, self.made + 1
            return F.col(name)

        return bind

    def apply(self, df: DataFrame) -> DataFrame:
        """df with all named expressions; the binder is empty afterwards."""
        for level in self.levels:
            df = df.withColumns(level)
        self.levels = []
        return df


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x) with x computed once, wherever the optimizer copies the whole expression to."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def let(cell: CellColumns | None, c: Column) -> Column:
    """c under a name, where the cell's plan can give it one."""
    return c if cell is None or cell.bind is None else cell.bind(c)


NAMED: dict[str, T.DataType] = {
    "string": T.StringType(), "int": T.IntegerType(), "integer": T.IntegerType(), "bigint": T.LongType(), "long": T.LongType(),
    "smallint": T.ShortType(), "double": T.DoubleType(), "float": T.FloatType(), "boolean": T.BooleanType(), "date": T.DateType(),
    "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(), "binary": T.BinaryType(),
}


def type_of(x: T.DataType | str) -> T.DataType:
    """A type by its SQL name; plain names, decimals and arrays are known without a session."""
    if isinstance(x, T.DataType):
        return x
    name = x.strip().lower()
    if name in NAMED:
        return NAMED[name]
    if name.startswith("array<") and name.endswith(">"):
        return T.ArrayType(type_of(name[6:-1]))
    if m := re.fullmatch(r"decimal\((\d+)\s*,\s*(\d+)\)", name):
        return T.DecimalType(int(m[1]), int(m[2]))
    return T.StructType.fromDDL(f"v {x}")["v"].dataType


NO_ERROR = lambda: F.lit(None).cast("string")


def quoted(c: Column) -> Column:
    """Text as Python shows it: in single quotes, or in double quotes if it holds single ones only."""
    esc = F.replace(F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t")), F.lit("\r"), F.lit("\\r"))
    single, double = F.contains(c, F.lit("'")), F.contains(c, F.lit('"'))
    return F.when(single & ~double, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'")))


@dataclass(frozen=True)
class Parser:
    """A parser compiled to Catalyst expressions.

    build(text, dtype, cell) gets the incoming column, its type and the cell's place, and returns a ParsedExpr.
    decode turns a collected value into the Python value users of objects expect.
    """

    name: str
    build: Callable[[Column, T.DataType, CellColumns | None], ParsedExpr] = field(repr=False)
    description: str = ""
    decode: Callable[[Any], Any] | None = field(default=None, repr=False)
    native: bool = True
    #: The Python function of a custom parser.
    function: Callable[[Any, Any], Any] | None = field(default=None, repr=False, compare=False)
    #: The type of its values, or a function to it from the type of what it is given; known without a session.
    kind: Any = T.StringType()

    def out(self, dtype: T.DataType) -> T.DataType:
        return self.kind if isinstance(self.kind, T.DataType) else self.kind(dtype)

    def apply(self, c: Column, dtype: T.DataType | None = None, cell: CellColumns | None = None) -> ParsedExpr:
        return self.build(c, dtype or T.StringType(), cell)

    @property
    def dtype(self) -> T.DataType:
        return self.out(T.StringType())


def as_text(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    return c.cast("string")


def fail_unless(ok: Column, value: Column, message: Column, dtype: T.DataType, given: Column, cell: CellColumns | None = None) -> ParsedExpr:
    """value where ok; the message where not, except for null input, which stays null."""
    good = let(cell, F.coalesce(ok, F.lit(False)))
    bad = given.isNotNull() & ~good
    return ParsedExpr(F.when(good, value).cast(dtype), F.when(bad, message), dtype, bad=bad)


def fail_null(value: Column, message: Column, dtype: T.DataType, given: Column, cell: CellColumns | None = None) -> ParsedExpr:
    """value; the message where it is null though something was given."""
    value = let(cell, value.cast(dtype))
    bad = given.isNotNull() & value.isNull()
    return ParsedExpr(value, F.when(bad, message), dtype, bad=bad)
