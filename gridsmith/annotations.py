"""Parsers inferred from annotations, and which annotations admit which outcomes."""

from __future__ import annotations

import types
import typing
from collections.abc import Callable, Hashable, Iterable, Mapping
from datetime import date, datetime
from decimal import Decimal
from enum import Enum
from typing import Any, Literal, Union

from .functions import parsers as P
from .functions.parsed import Parser


def members(annotation: Any) -> tuple[Any, ...]:
    """The alternatives of a union; other annotations are their own only one."""
    origin = typing.get_origin(annotation)
    return typing.get_args(annotation) if origin in (Union, types.UnionType) else (annotation,)


def infer(annotation: Any) -> Parser | None:
    """The parser of an annotation; None where text stays text or nothing can be inferred."""
    parts = members(annotation)
    if len(parts) > 1:
        rest = [p for p in parts if p is not type(None)]
        if len(rest) != 1 or len(rest) == len(parts):
            return None
        inner = P.identity() if rest[0] is str else infer(rest[0])
        return P.optional(inner) if inner is not None else None
    if typing.get_origin(annotation) is Literal:
        values = typing.get_args(annotation)
        return P.literal(*values) if all(isinstance(v, str) for v in values) else None
    if isinstance(annotation, type):
        if issubclass(annotation, Enum):
            return P.enum(annotation)
        makers = {int: P.integer, float: P.floating, bool: P.boolean, Decimal: P.decimal, date: P.date, datetime: P.datetime}
        if annotation in makers:
            return makers[annotation]()
    return None


def admits_text(annotation: Any) -> bool:
    """Whether any text may be a value of the annotation."""
    return any(p in (Any, object, str) for p in members(annotation))


#: Plain types whose values are told by their exact type, so that True is no int.
EXACT = (int, float, bool, str, Decimal, date, datetime)
Test = Callable[[Any], bool]


def admits(annotation: Any, value: Any) -> bool:
    """Whether a value is of the annotation."""
    return test_of(annotation)(value)


def test_of(annotation: Any) -> Test:
    """The annotation as a test of values; what it doesn't know admits everything."""
    parts = members(annotation)
    if len(parts) > 1:
        tests = [test_of(p) for p in parts]
        return lambda v: any(t(v) for t in tests)
    if annotation is Any or annotation is object:
        return lambda v: True
    if annotation in (None, type(None)):
        return lambda v: v is None
    if annotation in EXACT:
        return lambda v: type(v) is annotation
    if isinstance(annotation, type) and not typing.get_args(annotation):
        return lambda v: isinstance(v, annotation)
    kind = typing.get_origin(annotation)
    if kind is Literal:
        listed = {(type(x), x) for x in typing.get_args(annotation)}
        return lambda v: isinstance(v, Hashable) and (type(v), v) in listed
    return test_of_container(kind, typing.get_args(annotation)) if isinstance(kind, type) else lambda v: True


def test_of_container(kind: type, args: tuple[Any, ...]) -> Test:
    """A test of a container and of its items: by key and value, by place, or all alike."""
    tests = [test_of(a) for a in args if a is not ...]
    if issubclass(kind, Mapping):
        inside = lambda v: all(t(x) for pair in v.items() for t, x in zip(tests, pair))
    elif issubclass(kind, tuple) and ... not in args:
        inside = lambda v: len(v) == len(tests) and all(t(x) for t, x in zip(tests, v))
    elif tests and issubclass(kind, Iterable):
        inside = lambda v: all(map(tests[0], v))
    else:
        inside = lambda v: True
    return lambda v: isinstance(v, kind) and inside(v)
