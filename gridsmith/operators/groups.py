"""Column-group expansion: a key row names how many logical columns each source column stands for.

Rules are column functions, or plain Python functions, which run in Arrow batches. A range rule maps a key cell to
struct<items: array<string>, error: string, code: string>, a repeat rule maps a value cell and the number of keys to the same. Every array is
bounded before it is made.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..diagnostics import TableError
from ..functions.parsed import once
from ..functions.parsers import literal_regex
from ..sources.cells import COLUMNS, CellFrame

#: Fixed value: the most keys that one numeric range may stand for.
MOST_KEYS = 10_000
NONE = F.lit  # literal columns are made when a session exists


def separator(text: Any) -> str:
    if not isinstance(text, str) or not text:
        raise ValueError("separator must be text that isn't empty")
    return text


def outcome(values: Column, error: Column, code: Column | None = None) -> Column:
    code = code if code is not None else F.lit("transform_failed")
    return once(error, lambda e: F.struct(F.when(e.isNull(), values).alias("items"), e.alias("error"), F.when(e.isNotNull(), code).alias("code")))


def parts_of(c: Column, sep: str) -> Column:
    return F.split(c, literal_regex(sep), -1)


@dataclass(frozen=True)
class NumericRange:
    """1..3 stands for 1, 2, 3; a key without the separator stands for itself."""

    separator: str = ".."

    def __post_init__(self):
        separator(self.separator)

    def expand(self, c: Column) -> Column:
        whole = lambda x: F.when(F.trim(x).rlike(r"\A[+-]?[0-9]+\z"), F.trim(x).try_cast("bigint"))
        ends = lambda p: F.struct(F.size(p).alias("n"), whole(F.get(p, F.lit(0))).alias("a"), whole(F.get(p, F.lit(1))).alias("b"))

        def keys(x: Column) -> Column:
            n, a, b = x["n"], x["a"], x["b"]
            fits = F.coalesce((n == 2) & (a <= b), F.lit(False))
            few = b - a < MOST_KEYS
            wrong = F.concat(F.lit("Invalid numeric range: "), c)
            long = F.concat(F.lit(f"A numeric range stands for {MOST_KEYS} keys at most: "), c)
            error = F.when(n == 1, F.lit(None).cast("string")).when(~fits, wrong).when(~few, long)
            spread = F.transform(F.sequence(F.when(fits & few, a).otherwise(0), F.when(fits & few, b).otherwise(0)), lambda k: k.cast("string"))
            return outcome(F.when(n == 1, F.array(c)).otherwise(spread), error, F.when(fits, "expansion_limit").otherwise("transform_failed"))

        return once(once(parts_of(c, self.separator), ends), keys)


@dataclass(frozen=True)
class AlphabeticRange:
    """a-d stands for a, b, c, d: single ASCII letters of one case."""

    separator: str = "-"

    def __post_init__(self):
        separator(self.separator)

    def expand(self, c: Column) -> Column:
        def keys(p: Column) -> Column:
            a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
            alike = F.concat(a, b).rlike(r"\A(?:[a-z]{2}|[A-Z]{2})\z") & (F.length(a) == 1)
            ok = F.coalesce((F.size(p) == 2) & alike & (a <= b), F.lit(False))
            error = F.when((F.size(p) > 1) & ~ok, F.concat(F.lit("Invalid alphabetic range: "), c))
            letters = F.transform(F.sequence(F.when(ok, F.ascii(a)).otherwise(65), F.when(ok, F.ascii(b)).otherwise(65)), lambda x: F.char(x))
            return outcome(F.when(F.size(p) == 1, F.array(c)).otherwise(letters), error)

        return once(parts_of(c, self.separator), keys)


def repeated(c: Column, n: Column, count_text: Column, value: Column, found: Column) -> Column:
    """Copies of value if its count is the group's size; the cell as it is, for every key, where no count was found."""
    count = count_text.try_cast("int")
    empty = F.concat(F.lit("A repeated value must not be empty: "), c)
    other = F.concat(F.lit("The count differs from the group's size: "), c)
    error = F.when(found & (value == ""), empty).when(found & ~F.coalesce(count == n, F.lit(False)), other)
    return outcome(F.array_repeat(F.when(found, value).otherwise(c), n), error)


@dataclass(frozen=True)
class PrefixRepeat:
    """3:Article stands for three Articles; a cell without a count before the first separator is copied."""

    separator: str = ":"

    def __post_init__(self):
        separator(self.separator)

    def expand(self, c: Column, n: Column) -> Column:
        at = F.instr(c, F.lit(self.separator))
        head = F.substring(c, F.lit(1), at - 1)
        return repeated(c, n, head, F.substring(c, at + len(self.separator), F.length(c)), (at > 0) & head.rlike(r"\A[0-9]+\z"))


@dataclass(frozen=True)
class SuffixRepeat:
    """Article x3 stands for three Articles; a cell without a count behind the last separator is copied."""

    separator: str = " x"

    def __post_init__(self):
        separator(self.separator)

    def expand(self, c: Column, n: Column) -> Column:
        has = F.instr(c, F.lit(self.separator)) > 0
        tail = F.substring_index(c, self.separator, -1)
        value = F.substring(c, F.lit(1), F.length(c) - F.length(tail) - len(self.separator))
        return repeated(c, n, tail, value, has & tail.rlike(r"\A[0-9]+\z"))


OUTCOME = "items array<string>, error string, code string"


def told(call: Any, most: int | None) -> tuple[list[str] | None, str | None, str | None]:
    """What a Python rule gives for a cell: its texts, or an error and its code."""
    try:
        items = list(call())
        if any(not isinstance(x, str) for x in items):
            return None, "A rule must give texts", "invalid_transform"
        if most is not None and len(items) > most:
            return None, f"A range stands for {most} keys at most", "expansion_limit"
        return items, None, None
    except TableError as e:
        return None, e.diagnostic.message, str(e.diagnostic.code)
    except Exception as e:
        return None, str(e) or type(e).__name__, "transform_failed"


def as_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({name: pd.Series([r[i] for r in rows], dtype=object) for i, name in enumerate(("items", "error", "code"))})


class RangeRule(Protocol):
    """What the keys of a group are: a column function from a key cell to struct<items, error, code>."""

    def expand(self, c: Column) -> Column: ...


class RepeatRule(Protocol):
    """What the cells of a group are: a column function from a cell and the number of keys to struct<items, error, code>."""

    def expand(self, c: Column, n: Column) -> Column: ...


@dataclass(frozen=True)
class PythonRange:
    """A range rule as a Python function from a key cell's text to the keys it stands for, in Arrow batches."""

    function: Any

    def expand(self, c: Column) -> Column:
        function = self.function

        def run(cells: pd.Series) -> pd.DataFrame:
            return as_frame([told(lambda x=x: function(x), MOST_KEYS) for x in cells])

        return F.pandas_udf(run, OUTCOME)(c)


@dataclass(frozen=True)
class PythonRepeat:
    """A repeat rule as a Python function from a cell's text and the number of keys to one text for each key, in Arrow batches."""

    function: Any

    def expand(self, c: Column, n: Column) -> Column:
        function = self.function

        def run(cells: pd.Series, sizes: pd.Series) -> pd.DataFrame:
            return as_frame([told(lambda x=x, k=k: function(x, int(k)), None) for x, k in zip(cells, sizes)])

        return F.pandas_udf(run, OUTCOME)(c, n)


def as_range_rule(rule: Any) -> Any:
    return rule if hasattr(rule, "expand") else PythonRange(rule)


def as_repeat_rule(rule: Any) -> Any:
    return rule if hasattr(rule, "expand") else PythonRepeat(rule)


@dataclass(frozen=True)
class ColumnGroupExpander:
    """A transformer that expands column groups. key_label names the key row, the first one; columns behind the labels expand."""

    key_label: str
    range_rule: Any = NumericRange()
    repeat_rule: Any = PrefixRepeat()

    def transform(self, cells: CellFrame, context: Any, *, schema: Any = None) -> CellFrame:
        df, range_rule, repeat_rule = cells.df, as_range_rule(self.range_rule), as_repeat_rule(self.repeat_rule)
        fail = lambda message, code, **at: TableError(message, schema=schema, code=code, source_uri=at.pop("source_uri", cells.uri), **at)
        if cells.empty:
            raise fail("The table has no rows", "table_empty")
        keys = df.filter("row_idx = 1")
        groups = keys.filter("col_idx > 1").select("table_id", "col_idx", F.struct(*COLUMNS[3:]).alias("cell"), range_rule.expand(F.col("value")).alias("e"))
        opened = groups.select("table_id", "col_idx", F.col("e.items").alias("keys"))
        values = df.filter("row_idx > 1 AND col_idx > 1").join(opened, ["table_id", "col_idx"])
        n = F.size("keys")
        spread = values.select("table_id", "row_idx", "col_idx", F.struct(*COLUMNS[3:]).alias("cell"), repeat_rule.expand(F.col("value"), n).alias("e"), n.alias("n"))
        uneven = F.struct(F.col("e.items").alias("items"), F.lit("A repeat rule must give one value for each key").alias("error"), F.lit("invalid_transform").alias("code"))
        spread = spread.withColumn("e", F.when(F.col("e.error").isNotNull() | (F.size("e.items") == F.col("n")), F.col("e")).otherwise(uneven))
        self.raise_first(df, keys, groups, spread, fail)
        groups = opened
        # Where each source column's logical columns begin: a window over the key rows only.
        ahead = Window.partitionBy("table_id").orderBy("col_idx").rowsBetween(Window.unboundedPreceding, -1)
        before = groups.select("table_id", "col_idx", F.sum(F.size("keys")).over(ahead).alias("b"))
        before = before.select("table_id", "col_idx", F.coalesce("b", F.lit(0)).cast("int").alias("b"))
        key_cells = keys.filter("col_idx > 1").join(groups, ["table_id", "col_idx"]).join(before, ["table_id", "col_idx"])
        out_keys = self.dealt(key_cells.withColumn("items", F.col("keys")))
        rows = spread.select("table_id", "row_idx", "col_idx", "cell.*", F.col("e.items").alias("items")).join(before, ["table_id", "col_idx"])
        return CellFrame(df.filter("col_idx = 1").select(*COLUMNS).unionByName(out_keys).unionByName(self.dealt(rows)), None, cells.uri)

    @staticmethod
    def dealt(df: DataFrame) -> DataFrame:
        got = df.select("table_id", "row_idx", "b", *COLUMNS[4:], F.posexplode("items").alias("p", "value"))
        return got.withColumn("col_idx", (F.col("b") + F.col("p") + 2).cast("int")).select(*COLUMNS)

    def raise_first(self, df: DataFrame, keys: DataFrame, groups: DataFrame, spread: DataFrame, fail: Any) -> None:
        """The first thing that is wrong, by kind, table and place, found in one job."""
        cell = [F.col(f"cell.{n}").alias(n) for n in COLUMNS[3:]]
        nothing = {"value": "string", "source_row": "int", "source_column": "int", "source_value": "string", "source_uri": "string"}

        def problem(rank: int, at: DataFrame, error: Column, code: Column, columns: list[Column]) -> DataFrame:
            return at.select(F.lit(rank).alias("rank"), "table_id", "col_idx", error.alias("error"), code.alias("code"), *columns)

        sizes = df.groupBy("table_id", "row_idx").agg(F.count("*").alias("n"), F.min("source_row").alias("source_row"), F.min("source_uri").alias("source_uri"))
        width = sizes.filter("row_idx = 1").select("table_id", F.col("n").alias("w"))
        ragged = sizes.join(width, "table_id").filter("n != w").withColumn("col_idx", F.lit(0))
        text = F.concat(F.lit("Row "), F.col("source_row").cast("string"), F.lit(" has "), F.col("n").cast("string"), F.lit(" cells, the key row "), F.col("w").cast("string"))
        own = [F.col(n) if n in ("source_row", "source_uri") else F.lit(None).cast(t).alias(n) for n, t in nothing.items()]
        wrong_head = keys.filter((F.col("col_idx") == 1) & (F.col("value") != self.key_label))
        found = problem(1, ragged, text, F.lit("ragged_row"), own)
        found = found.unionByName(problem(2, wrong_head, F.lit(f"The first row must be {self.key_label!r}"), F.lit("invalid_transform"), [F.col(n) for n in nothing]))
        for rank, frame in ((3, groups), (4, spread)):
            found = found.unionByName(problem(rank, frame.filter(F.col("e.error").isNotNull()), F.col("e.error"), F.col("e.code"), cell))
        none = [F.lit(None).cast(t).alias(n) for n, t in nothing.items()]
        any_cell = problem(9, df.limit(1), F.lit(""), F.lit(""), none)
        got = found.unionByName(any_cell).orderBy("rank", "table_id", "source_row", "col_idx").limit(1).collect()
        if not got:
            raise fail("The table has no rows", "table_empty")
        r = got[0]
        if r["rank"] < 9:
            more = {} if r["rank"] == 1 else {"column": r["source_column"], "source_value": r["source_value"], "logical_value": r["value"]}
            raise fail(r["error"], r["code"], row=r["source_row"], source_uri=r["source_uri"], **more)
