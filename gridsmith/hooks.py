"""Python hooks inside Spark: cell parsers and default factories as pandas UDFs, in Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .context import CellContext, DefaultContext
from .diagnostics import TableError
from .functions.parsed import CellColumns


def plain(v: Any) -> Any:
    return None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v


def identity(text: Any) -> Any:
    """An id of its JSON text."""
    return json.loads(text) if isinstance(text, str) else plain(text)


def result_type(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("value", kind), T.StructField("error", T.StringType()), T.StructField("code", T.StringType())])


def guarded(call: Callable[[], Any], kind: T.DataType) -> tuple[Any, str | None, str | None]:
    try:
        value = call()
        kind.toInternal(value) if kind.needConversion() else None
        return value, None, None
    except TableError as e:
        return None, e.diagnostic.message, str(e.diagnostic.code)
    except Exception as e:
        return None, str(e) or type(e).__name__, None


def as_frame(rows: list[tuple[Any, str | None, str | None]]) -> pd.DataFrame:
    return pd.DataFrame({"value": pd.Series([r[0] for r in rows], dtype=object), "error": pd.Series([r[1] for r in rows], dtype=object), "code": pd.Series([r[2] for r in rows], dtype=object)})


def cell_udf(function: Callable[[Any, Any], Any], kind: T.DataType, cell: CellColumns):
    """A UDF from a cell's struct to (value, error, code)."""
    name, label, data = cell.field, cell.label, dict(cell.user_data or {})

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in cells.to_dict("records"):
            value = r["value"]
            context = CellContext(name, label, plain(r["row"]), plain(r["column"]), identity(r["item_id"]), r["source_value"], r["source_uri"], data)
            rows.append((None, None, None) if value is None else guarded(lambda v=value, c=context: function(v, c), kind))
        return as_frame(rows)

    return F.pandas_udf(run, result_type(kind))


def outcome_of(got: Any) -> tuple[Any, str | None, str | None]:
    """A batch function's item: a value, or an exception that fails its cell."""
    if isinstance(got, TableError):
        return None, got.diagnostic.message, str(got.diagnostic.code)
    if isinstance(got, Exception):
        return None, str(got) or type(got).__name__, None
    return plain(got), None, None


def batch_udf(function: Callable[[pd.Series], Any], kind: T.DataType, cell: CellColumns):
    """A UDF from texts to (value, error, code) by one call of function for each Arrow batch, without its nulls."""

    def run(texts: pd.Series) -> pd.DataFrame:
        there = texts[texts.notna()]
        rows: list[tuple[Any, str | None, str | None]] = [(None, None, None)] * len(texts)
        if len(there):
            try:
                got = list(function(there))
                if len(got) != len(there):
                    raise ValueError(f"a batch of {len(there)} cells gave {len(got)} values")
            except Exception as e:
                got = [e] * len(there)
            for at, x in zip(texts.index.get_indexer(there.index), got):
                rows[at] = outcome_of(x)
        return as_frame(rows)

    return F.pandas_udf(run, result_type(kind))


def default_udf(function: Callable[[Any], Any], kind: T.DataType, cell: CellColumns):
    """A UDF from a record's struct to the value a default factory gives."""
    name, label, data = cell.field, cell.label, dict(cell.user_data or {})

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in cells.to_dict("records"):
            context = DefaultContext(name, label, identity(r["item_id"]), plain(r["row"]), plain(r["column"]), r["source_uri"], data)
            rows.append(guarded(lambda c=context: function(c), kind))
        return as_frame(rows)

    return F.pandas_udf(run, result_type(kind))
