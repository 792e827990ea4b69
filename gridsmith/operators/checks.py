"""Declarative checks of records and tables, and the Python hooks.

A record check is one more boolean in the projection of records; like SQL's CHECK, it fails where its condition is false, not where it
is null. Table checks are aggregates: one pass for counts, and a count by key for unique values. Python hooks of records run in Arrow
batches on the executors. The Python hook of a whole table is by contract given all its records, so it runs on the driver, table after
table, with the records of one table held at a time; tables too large for that want declared checks.
"""

from __future__ import annotations

import importlib
import json
import warnings
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import diagnostics as D
from ..context import ParseContext
from ..diagnostics import Diagnostic, SchemaDefinitionError, TableError, TableErrors, to_row
from ..plans.records import DIAGS, Converted, any_of
from ..schema import Plan
from .references import no_errors
from .shape import diag

Condition = str | Column | Callable[[], Column]


def column_of(x: Condition) -> Column:
    return F.expr(x) if isinstance(x, str) else x() if callable(x) and not isinstance(x, Column) else x


@dataclass(frozen=True)
class Check:
    """Each record must meet the condition, over its typed fields; at names the field that a failure points to."""

    condition: Condition
    message: str
    code: str = "record_validation_failed"
    severity: str = D.ERROR
    at: str | None = None
    variant: Any = None


@dataclass(frozen=True)
class Unique:
    """No two records have equal values of the fields; later ones are reported. Nulls are equal to each other."""

    fields: tuple[str, ...]
    message: str = "Values must be unique"
    code: str = "table_validation_failed"
    severity: str = D.ERROR
    looks_at_order = True


@dataclass(frozen=True)
class AtLeast:
    """At least n records of each table meet the condition."""

    n: int
    condition: Condition
    message: str = "Too few records"
    code: str = "table_validation_failed"
    severity: str = D.ERROR


@dataclass(frozen=True)
class AllRows:
    """Every record meets the condition; one diagnostic for a table."""

    condition: Condition
    message: str = "Not all records meet the condition"
    code: str = "table_validation_failed"
    severity: str = D.ERROR


@dataclass(frozen=True)
class Aggregate:
    """An aggregate of each table meets a predicate, written over the column `value`."""

    expression: Condition
    predicate: str
    message: str = "The table's aggregate is out of bounds"
    code: str = "table_validation_failed"
    severity: str = D.ERROR


def check(condition: Condition, message: str, **options: Any) -> Check:
    return Check(condition, message, **options)


def unique(*fields: str, **options: Any) -> Unique:
    return Unique(fields, **options)


def at_least(n: int, condition: Condition, **options: Any) -> AtLeast:
    return AtLeast(n, condition, **options)


def all_rows(condition: Condition, **options: Any) -> AllRows:
    return AllRows(condition, **options)


def aggregate(expression: Condition, predicate: str, **options: Any) -> Aggregate:
    return Aggregate(expression, predicate, **options)


def checks_of(plan: Plan) -> list[tuple[str | None, Plan, int, Any]]:
    out, seen = [], set()
    for v, p in [(None, plan), *plan.variants.items()]:
        for i, c in enumerate(p.checks):
            if isinstance(c, Check) and id(c) not in seen:
                seen.add(id(c))
                out.append((None if v is None else str(getattr(v, "name", v)), p, i, c))
    return out


def check_records(c: Converted, context: ParseContext) -> Converted:
    """Failed record checks, then failed Python hooks, behind the diagnostics of each record that has no error yet."""
    made, failed = [], []
    for v, p, i, k in checks_of(c.plan):
        bad = F.coalesce(~column_of(k.condition), F.lit(False))
        if v is not None:
            bad = bad & F.coalesce(F.col("_variant") == v, F.lit(False))
        if k.severity == D.ERROR:
            failed.append(bad)
        if k.at is None:
            at = {"row": F.col("_row"), "column": F.col("_column"), "uri": F.col("_uri")}
        else:
            f = p.fields[k.at]
            cell = F.coalesce(*(F.try_element_at("_source.cells", F.lit(x)) for x in f.labels))
            uri = F.coalesce(cell["source_uri"], F.col("_uri"))
            at = {"row": cell["source_row"], "column": cell["source_column"], "uri": uri, "name": f.name, "label": f.label}
            at |= {"source": cell["source_value"], "logical": cell["value"]}
        at |= {"phase": D.VALIDATION, "step": 0, "step_ordinal": i, "schema": p.name, "severity": k.severity}
        made.append(F.when(bad, diag(k.code, k.message, item=F.col("_item"), ordinal=F.col("_ordinal"), **at)))
    df = c.df
    if made:
        # Records with an error keep what they have; others have no diagnostic yet.
        checked = F.when(no_errors(), F.array_compact(F.array(*made))).otherwise(F.array().cast(DIAGS))
        df = df.withColumns({"_diag": F.concat("_diag", checked).cast(DIAGS), "_ok": F.col("_ok") & ~any_of(failed)})
    hooks = {None if v is None else str(getattr(v, "name", v)): p for v, p in [(None, c.plan), *c.plan.variants.items()]}
    if any(p.hook("validate_record") for p in hooks.values()):
        df = run_record_hooks(df, c, hooks, context)
    return Converted(c.plan, df, c.header, c.fields)


class RecordView:
    """A record where its schema class can't be imported, on an executor."""

    def __init__(self, values: dict[str, Any], source: Any, extras: dict[str, str]):
        self.__dict__.update(values)
        self.table_source, self.table_extras = source, extras
        self._fields = list(values)

    def as_dict(self) -> dict[str, Any]:
        return {k: self.__dict__[k] for k in self._fields}

    def source_for(self, name: str) -> Any:
        return self.table_source.cells[name]


def importable(cls: type) -> bool:
    if cls.__module__ == "__main__" or "<locals>" in cls.__qualname__ or "[" in cls.__qualname__:
        return False
    try:
        return getattr(importlib.import_module(cls.__module__), cls.__qualname__, None) is cls
    except ImportError:
        return False


#: Steps of what hooks found. A raised aggregate of errors only ends a strict run by itself: nothing but it is reported.
AGGREGATE, RECORD_HOOK, TABLE_HOOK = -1, 1, 3


def findings(call: Callable[[], Any], wrap: Callable[[Exception], TableError], step: int) -> tuple[list[Diagnostic], int]:
    """What a hook raised, as diagnostics, and their step: AGGREGATE for several errors without a warning among them."""
    try:
        call()
    except TableError as e:
        return [e.diagnostic], step
    except TableErrors as e:
        found = list(e.diagnostics)
        return found, step if any(d.severity == D.WARNING for d in found) else AGGREGATE
    except SchemaDefinitionError:
        raise
    except Exception as e:
        return [wrap(e).diagnostic], step
    return [], step


def run_record_hooks(df: DataFrame, c: Converted, hooks: dict[str | None, Plan], context: ParseContext) -> DataFrame:
    from ..output import decoded, source_of

    schema = T.StructType([*df.schema.fields, T.StructField("_hooked", DIAGS)])
    arrow = to_arrow_schema(schema)
    parts = {}
    for v, p in hooks.items():
        hook = p.hook("validate_record")
        fields = {f.name: ((f.parser.decode if f.parser else None), f.labels) for f in p.fields.values()}
        parts[v] = (hook, fields, p.schema if importable(p.schema) else None, p.name)
    names = list(c.fields)

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                hook, fields, cls, name = parts.get(r["_variant"], parts.get(None))
                if hook is None or not r["_ok"]:
                    out.append([])
                    continue
                values = decoded(r, fields, names)
                source = source_of(r, fields)
                record = cls._of(values, source, dict(r["_extras"] or [])) if cls else RecordView(values, source, dict(r["_extras"] or []))
                item = None if r["_item"] is None else json.loads(r["_item"])
                at = {"schema": name, "row": r["_row"], "column": r["_column"], "item_id": item, "source_uri": r["_uri"]}

                def wrap(e: Exception, at: dict = at) -> TableError:
                    return TableError(f"Record validation failed: {e}", code="record_validation_failed", **at)

                got, step = findings(lambda: hook(record, context), wrap, RECORD_HOOK)
                rows = [to_row(d, D.VALIDATION, r["_ordinal"] or 0, step, i) for i, d in enumerate(got)]
                out.append([dict(zip(D.DIAGNOSTIC.names, x)) for x in rows])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow.field("_hooked").type)], schema=arrow)

    hooked = df.mapInArrow(run, schema)
    ok = F.col("_ok") & ~F.exists("_hooked", lambda d: d["severity"] == D.ERROR)
    return hooked.withColumns({"_diag": F.concat("_diag", "_hooked").cast(DIAGS), "_ok": ok}).drop("_hooked")


def check_tables(c: Converted) -> DataFrame | None:
    """Diagnostics of whole tables, over records without errors."""
    own = [(i, k) for i, k in enumerate(c.plan.checks) if not isinstance(k, Check)]
    if not own:
        return None
    good = c.df.filter(no_errors())
    out: list[DataFrame] = []
    counted = {}
    for i, k in own:
        if isinstance(k, Unique):
            # Counts by key come first; the records themselves are joined to the repeated keys only.
            keys = [f"`{f}`" for f in k.fields]
            often = good.groupBy("_table_id", *keys).agg(F.count("*").alias("__n"), F.min("_ordinal").alias("__first")).filter("__n > 1")
            on = F.col("g._table_id") == F.col("o._table_id")
            for f in keys:
                on = on & F.col(f"g.{f}").eqNullSafe(F.col(f"o.{f}"))
            again = good.alias("g").join(often.alias("o"), on & (F.col("g._ordinal") > F.col("o.__first"))).select("g.*")
            f = c.plan.fields.get(k.fields[0])
            cell = F.coalesce(*(F.try_element_at("_source.cells", F.lit(x)) for x in f.labels)) if f else F.lit(None)
            place = {"row": F.col("_row"), "column": F.col("_column")}
            if f:
                place = {"row": cell["source_row"], "column": cell["source_column"], "source": cell["source_value"], "label": f.label}
            at = {"phase": D.VALIDATION, "step": 2, "step_ordinal": i, "schema": c.plan.name, "severity": k.severity, "name": k.fields[0]}
            d = diag(k.code, k.message, ordinal=F.col("_ordinal"), uri=F.col("_uri"), item=F.col("_item"), **at, **place)
            out.append(again.select("_table_id", d.alias("d")).select("_table_id", "d.*"))
        elif isinstance(k, AtLeast):
            counted[i] = F.count_if(F.coalesce(column_of(k.condition), F.lit(False))) < k.n
        elif isinstance(k, AllRows):
            counted[i] = F.count_if(F.coalesce(~column_of(k.condition), F.lit(False))) > 0
        elif isinstance(k, Aggregate):
            counted[i] = column_of(k.expression)
        else:
            raise SchemaDefinitionError(f"not a check: {k!r}", schema=c.plan.name)
    if counted:
        # One pass for all; every table counts, also one without a good record.
        tables = c.df.select("_table_id").distinct()
        sums = good.groupBy("_table_id").agg(*(x.alias(f"__{i}") for i, x in counted.items()), F.min("_uri").alias("__u"))
        sums = tables.join(sums, "_table_id", "left")
        for i, k in own:
            if i in counted:
                value = F.col(f"__{i}")
                if isinstance(k, Aggregate):
                    bad = F.coalesce(~F.expr(k.predicate.replace("value", f"__{i}")), F.lit(True))
                else:
                    bad = F.coalesce(value, F.lit(isinstance(k, AtLeast) and k.n > 0))
                at = {"phase": D.VALIDATION, "step": 2, "step_ordinal": i, "schema": c.plan.name, "severity": k.severity}
                d = diag(k.code, k.message, ordinal=F.lit(2**62), uri=F.col("__u"), **at)
                out.append(sums.filter(bad).select("_table_id", d.alias("d")).select("_table_id", "d.*"))
    total = out[0]
    for x in out[1:]:
        total = total.unionByName(x)
    return total


def run_table_hook(plan: Plan, records: list[Any], context: ParseContext) -> tuple[list[Diagnostic], int]:
    """What the Python hook over all records of a table found, and its step."""
    uri = records[0].table_source.source_uri if records else None
    wrap = lambda e: TableError(f"Table validation failed: {e}", schema=plan.schema, source_uri=uri, code="table_validation_failed", cause=e)
    return findings(lambda: plan.hook("validate_records")(records, context), wrap, TABLE_HOOK)


def emit(found: list[Diagnostic]) -> None:
    for d in found:
        if d.severity == D.WARNING:
            warnings.warn(D.TableWarning(d), stacklevel=3)
