"""A project's own cell vocabulary, compiled to one chain of conditions.

Rules are tried in this order: tokens of a field, tokens of all fields, patterns and then predicates in the order given, the
fallback. Text that no rule matches passes through. A rule's result is a column function, a literal or a Python function:

    dsl.token("today", to=lambda cell: F.current_date().cast("string"))     native
    @dsl.pattern(r"src(?P<n>\\d+)")                                           Python, in Arrow batches
    def source(match, context): return match["n"]
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .parsed import NO_ERROR, CellColumns, ParsedExpr, Parser, as_text, type_of

_NONE = object()


def java_regex(pattern: str) -> str:
    """A Python pattern in Java's syntax: groups lose their names, whose numbers stay."""
    compiled = re.compile(pattern)
    numbers = compiled.groupindex
    out = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\{numbers[m[1]]}", pattern)
    out = re.sub(r"\(\?P<\w+>", "(", out)
    if re.search(r"\(\?\(|\(\?[aLu]", out):
        raise ValueError(f"the pattern {pattern!r} has syntax that Java's regular expressions lack")
    return "(?d)\\A(?:" + out.replace("\\Z", "\\z") + ")\\z"


@dataclass(frozen=True)
class Rule:
    kind: str  # token, pattern, when, fallback
    match: Any
    fields: frozenset[str] | None
    to: Any  # native result, or _NONE
    function: Callable | None  # Python result


def field_names(fields: Any) -> frozenset[str] | None:
    if fields is None:
        return None
    names = frozenset([fields] if isinstance(fields, str) else fields)
    if not names or not all(isinstance(n, str) and n for n in names):
        raise ValueError("fields must name at least one field")
    return names


class CellDSL:
    """Rules of one vocabulary; returns is the type of what they result in."""

    def __init__(self, returns: T.DataType | str = "string"):
        self.returns = type_of(returns)
        self.rules: list[Rule] = []

    def _add(self, kind: str, match: Any, fields: Any, to: Any):
        names = field_names(fields)

        def add(to: Any, function: Callable | None):
            if kind == "fallback" and any(r.kind == "fallback" for r in self.rules):
                raise ValueError("a vocabulary has one fallback at most")
            if kind == "token":
                for r in self.rules:
                    if r.kind == "token" and r.match == match and (r.fields == names if r.fields is None or names is None else r.fields & names):
                        raise ValueError(f"the token {match!r} is already registered for these fields")
            if kind == "pattern" and any(r.kind == "pattern" and r.match == match and r.fields == names for r in self.rules):
                raise ValueError(f"the pattern {match!r} is already registered for these fields")
            self.rules.append(Rule(kind, match, names, to, function))
            return function

        if to is _NONE:
            return lambda function: add(_NONE, function)
        add(to, None)
        return self

    def token(self, value: str, *, fields: Any = None, to: Any = _NONE):
        """Exactly this text. Python functions get (context); column functions get the cell."""
        if not isinstance(value, str) or not value:
            raise ValueError("a token must be text that isn't empty")
        return self._add("token", value, fields, to)

    def pattern(self, regex: str, *, fields: Any = None, to: Any = _NONE):
        """Text that the pattern matches as a whole. Python functions get (match, context); column functions get a function
        from a group's name or number to its column."""
        re.compile(regex)
        if to is not _NONE:
            java_regex(regex)
        return self._add("pattern", regex, fields, to)

    def when(self, predicate: Callable, *, fields: Any = None, to: Any = _NONE):
        """Text of which a predicate is true. With `to`, predicate maps a column to a boolean column; else (text, context)."""
        if not callable(predicate):
            raise TypeError("a predicate must be callable")
        return self._add("when", predicate, fields, to)

    def fallback(self, function: Callable | None = None, *, to: Any = _NONE):
        """What text becomes that nothing else matches. Python functions get (text, context)."""
        made = self._add("fallback", None, None, to)
        return made(function) if function is not None else made

    def compose(self, *others: CellDSL) -> CellDSLChain:
        return CellDSLChain(self, *others)

    def __or__(self, other: CellDSL) -> CellDSLChain:
        return self.compose(other)

    def chain(self, c: Column, cell: CellColumns | None) -> list[tuple[Column, ParsedExpr]]:
        """(condition, result) of all rules for the cell's field, in the order they are tried."""
        name = cell.field if cell else None
        rules = [r for r in self.rules if r.fields is None or (name is not None and name in r.fields)]
        rank = {"token": 0, "pattern": 1, "when": 2, "fallback": 3}
        rules.sort(key=lambda r: (rank[r.kind], r.kind == "token" and r.fields is None))
        return [self.compiled(r, c, cell) for r in rules]

    def compiled(self, r: Rule, c: Column, cell: CellColumns | None) -> tuple[Column, ParsedExpr]:
        function = r.function
        if r.kind == "token":
            on = c == F.lit(r.match)
            python = lambda text, ctx: function(ctx)
        elif r.kind == "pattern":
            regex = r.match
            python = lambda text, ctx: function(re.fullmatch(regex, text), ctx)
            on = c.rlike(java_regex(regex)) if r.to is not _NONE else self.python_test(lambda text, ctx: re.fullmatch(regex, text) is not None, c, cell)
        elif r.kind == "when":
            test = r.match
            python = lambda text, ctx: function(text, ctx)
            on = test(c) if r.to is not _NONE else self.python_test(test, c, cell)
        else:
            on = F.lit(True)
            python = lambda text, ctx: function(text, ctx)
        if r.to is _NONE:
            from .parsers import custom

            return on, custom(python, returns=self.returns).apply(F.when(on, c), T.StringType(), cell)
        if callable(r.to):
            given = (lambda g: F.regexp_extract(c, java_regex(r.match), g if isinstance(g, int) else re.compile(r.match).groupindex[g])) if r.kind == "pattern" else c
            value = r.to(given)
        else:
            value = r.to if isinstance(r.to, Column) else F.lit(r.to)
        return on, ParsedExpr(value.cast(self.returns), NO_ERROR(), self.returns)

    @staticmethod
    def python_test(test: Callable, c: Column, cell: CellColumns | None) -> Column:
        from .parsers import custom

        got = custom(lambda text, ctx: bool(test(text, ctx)), returns="boolean").apply(c, T.StringType(), cell)
        # A predicate that fails claims the cell, so that its error is reported.
        return F.coalesce(got.value, got.error.isNotNull(), F.lit(False))

    def as_parser(self) -> Parser:
        return CellDSLChain(self).as_parser()


class CellDSLChain:
    """Vocabularies in turn: the first one with a rule that matches counts."""

    def __init__(self, *parts: CellDSL):
        if not parts or not all(isinstance(p, CellDSL) for p in parts):
            raise TypeError("a chain takes CellDSL objects")
        if len({p.returns for p in parts}) > 1:
            raise ValueError("vocabularies of a chain must have results of one type")
        self.parts = parts

    def as_parser(self) -> Parser:
        kind = self.parts[0].returns

        def build(c, dtype, cell):
            c = as_text(c, dtype)
            value, error, code = c.try_cast(kind), NO_ERROR(), NO_ERROR()
            for on, got in reversed([x for p in self.parts for x in p.chain(c, cell)]):
                on = F.coalesce(on, F.lit(False))
                value, error = F.when(on, got.value).otherwise(value), F.when(on, got.error).otherwise(error)
                code = F.when(on, got.code if got.code is not None else NO_ERROR()).otherwise(code)
            return ParsedExpr(value, error, kind, code)

        native = all(r.to is not _NONE for p in self.parts for r in p.rules)
        return Parser("cell_dsl", build, "cell_dsl()", native=native, kind=kind)


def compose_cell_dsls(*parts: CellDSL) -> CellDSLChain:
    return CellDSLChain(*parts)


__all__: Iterable[str] = ["CellDSL", "CellDSLChain", "compose_cell_dsls"]
