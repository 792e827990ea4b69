"""The lifecycle: normalise, transform, orient, convert, resolve references, validate, give out."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import diagnostics as D
from .context import ParseContext
from .diagnostics import Diagnostic, SchemaDefinitionError, TableError, TableErrors, as_error, from_row, to_row
from .operators import checks as C
from .operators import references as R
from .operators import shape
from .operators.transforms import checked
from .output import build_outputs, build_records, has_target
from .plans.records import SYSTEM, Converted, convert
from .schema import COLUMN, Plan, seal
from .sources.cells import CellFrame, session


@dataclass
class Result:
    """What a table became, lazily: good records, the others with their diagnostics, and all diagnostics."""

    plan: Plan
    all_records: DataFrame
    diagnostics: DataFrame
    strict: bool = False
    _counts: tuple[int, int] | None = field(default=None, repr=False)

    @property
    def fields(self) -> list[str]:
        return [c for c in self.all_records.columns if c not in SYSTEM]

    @property
    def records(self) -> DataFrame:
        """Typed fields and provenance of records without errors; of a strict result, those of tables without errors."""
        good = self.all_records.filter(R.no_errors())
        if self.strict:
            bad = self.diagnostics.filter(F.col("severity") == D.ERROR).select(F.col("_table_id").alias("_bad")).distinct()
            good = good.join(bad, F.col("_table_id") == F.col("_bad"), "left_anti")
        return good.select(*self.fields, "_variant", "_extras", "_source", "_table_id", "_ordinal", "_row", "_column", "_uri", "_item")

    def with_referenced(self, name: str) -> DataFrame:
        """records with <name>_record: the fields of the record that a reference names, or of each in order, as structs.

        As in the lookup itself, a record that could be converted may be named, also where a reference or check of its own fails.
        """
        f = next(x for p in self.plan.family for x in p.fields.values() if x.name == name and x.reference is not None)
        good = self.records
        fields = F.struct(*(F.col(f"`{c}`") for c in self.fields)).alias("__found")
        converted = ~F.exists("_diag", lambda d: (d["severity"] == D.ERROR) & (d["phase"] < D.REFERENCES))
        targets = self.all_records.filter(converted).select(F.col("_table_id").alias("__table"), F.col(f"`{f.reference.target}`").alias("__target"), fields).filter("__target IS NOT NULL")
        new = f"{name}_record"
        if not f.reference.many:
            on = (F.col("_table_id") == F.col("__table")) & (F.col(f"`{name}`") == F.col("__target"))
            return good.join(targets, on, "left").withColumnRenamed("__found", new).drop("__table", "__target")
        spread = good.select(F.col("_table_id").alias("__t"), F.col("_ordinal").alias("__o"), F.posexplode(name).alias("__place", "__key"))
        met = spread.join(targets, (F.col("__t") == F.col("__table")) & (F.col("__key") == F.col("__target")))
        lists = met.groupBy("__t", "__o").agg(F.sort_array(F.collect_list(F.struct("__place", "__found"))).alias("__all"))
        lists = lists.select("__t", "__o", F.transform("__all", lambda x: x["__found"]).alias(new))
        joined = good.join(lists, (F.col("_table_id") == F.col("__t")) & (F.col("_ordinal") == F.col("__o")), "left")
        empty = F.array().cast(lists.schema[new].dataType)
        return joined.withColumn(new, F.coalesce(new, F.when(F.col(f"`{name}`").isNotNull(), empty))).drop("__t", "__o")

    @property
    def rejected(self) -> DataFrame:
        return self.all_records.filter(~R.no_errors())

    def ordered(self) -> DataFrame:
        """Diagnostics in discovery order."""
        return self.diagnostics.orderBy("_table_id", *D.ORDER)

    @property
    def counts(self) -> tuple[int, int]:
        """Errors and warnings."""
        if self._counts is None:
            r = self.diagnostics.agg(F.count_if(F.col("severity") == D.ERROR).alias("e"), F.count_if(F.col("severity") == D.WARNING).alias("w")).first()
            self._counts = (r["e"], r["w"])
        return self._counts

    @property
    def valid(self) -> bool:
        return self.counts[0] == 0

    def collect_diagnostics(self) -> list[Diagnostic]:
        return [from_row(r) for r in self.ordered().collect()]

    @property
    def errors(self) -> list[Diagnostic]:
        return [d for d in self.collect_diagnostics() if d.severity == D.ERROR]

    @property
    def warnings(self) -> list[Diagnostic]:
        return [d for d in self.collect_diagnostics() if d.severity == D.WARNING]


def frame_of(schema: type, table: Any, context: ParseContext, *, ordinal: str | None = None, uri: str | None = None, table_id: str | None = None) -> shape.RecordFrame:
    """The record frame of any table: rows, cells, pandas, or a frame whose columns are labels."""
    plan = seal(schema)
    transforms = bool(plan.transformers) or plan.hook("transform_table") is not None
    if isinstance(table, DataFrame) and not transforms and plan.orientation != COLUMN:
        return shape.from_wide(table, plan, ordinal=ordinal, uri=uri, table_id=table_id)
    try:
        if isinstance(table, DataFrame):
            if ordinal is None:
                raise ValueError("this schema reads cells, so a frame needs ordinal= to number its rows")
            cells = CellFrame.from_wide(table, ordinal=ordinal, uri=uri)
        else:
            cells = CellFrame.ensure(table, **({"source": uri} if uri and not isinstance(table, CellFrame) else {}))
    except (TypeError, ValueError) as e:
        raise TableError(f"Invalid table input: {e}", schema=schema, code="invalid_table_input", cause=e) from e
    not_empty(cells, schema)
    if transforms:
        try:
            out = schema.transform_table(cells, context)
        except (TableError, TableErrors, SchemaDefinitionError):
            raise
        except Exception as e:
            raise TableError(f"Table transformation failed: {e}", schema=schema, code="transform_failed", source_uri=cells.uri, cause=e) from e
        cells = checked(out, cells, schema)
        if cells.empty is None and cells.df.isEmpty():
            cells = CellFrame(cells.df, "table_empty", cells.uri)
        not_empty(cells, schema)
    return shape.from_cells(cells, plan)


def not_empty(cells: CellFrame, schema: type) -> None:
    if cells.empty:
        text = "The table has no rows" if cells.empty == "table_empty" else "The first row is empty"
        raise TableError(text, schema=schema, code=cells.empty, source_uri=cells.uri, row=1 if cells.empty == "header_empty" else None, hint=D.HINTS[cells.empty])


def lenient(schema: type, table: Any, *, context: Any = None, **options: Any) -> Result:
    """A lazy result: every record stands for itself, and later phases look at records that are good so far."""
    data = ParseContext.of(context, schema)
    c = convert(schema, frame_of(schema, table, data, **options), data.user_data)
    c, ambiguous = R.resolve(c)
    c = C.check_records(c, data)
    # explode_outer, as from explode() the optimizer would infer a filter that computes all diagnostics a second time.
    own = c.df.select("_table_id", F.explode_outer("_diag").alias("d")).filter(F.col("d").isNotNull())
    parts = [own.select("_table_id", "d.*")]
    parts += [x for x in (c.header, ambiguous, C.check_tables(c)) if x is not None]
    total = parts[0]
    for x in parts[1:]:
        total = total.unionByName(x)
    return Result(c.plan, c.df, total)


def barrier(found: DataFrame) -> DataFrame:
    """Diagnostics up to the first phase of their table that has an error; of a raised aggregate, only those of the first one."""
    error = F.col("severity") == D.ERROR
    aggregate = F.when((F.col("phase") == D.VALIDATION) & (F.col("step") == C.AGGREGATE), F.col("record_ordinal"))
    ends = found.filter(error).groupBy(F.col("_table_id").alias("_t")).agg(F.min("phase").alias("_p"), F.min(aggregate).alias("_r"))
    joined = found.join(ends, F.col("_table_id") == F.col("_t"), "left")
    reached = F.col("_p").isNull() | (F.col("phase") <= F.col("_p"))
    ended = (F.col("_p") == D.VALIDATION) & F.col("_r").isNotNull()
    own = F.coalesce(aggregate == F.col("_r"), F.lit(False))
    return joined.filter(reached & (~F.coalesce(ended, F.lit(False)) | own)).drop("_t", "_p", "_r")


def failed(schema: type, found: list[Diagnostic]) -> Result:
    """The result of a table that couldn't be read at all."""
    spark, plan = session(), schema.__plan__
    rows = spark.createDataFrame([to_row(d, D.INPUT, 0, 0, i) for i, d in enumerate(found)], D.DIAGNOSTIC).withColumn("_table_id", F.lit(""))
    kinds = ", ".join(f"`{f.name}` {f.dtype.simpleString()}" for f in plan.fields.values())
    system = "_table_id string, _ordinal bigint, _row int, _column int, _uri string, _item string, _variant string, _extras map<string,string>, _source string, _ok boolean"
    empty = spark.createDataFrame([], f"{system}{', ' if kinds else ''}{kinds}").withColumn("_diag", F.array().cast("array<" + D.DIAGNOSTIC.simpleString() + ">"))
    return Result(plan, empty, rows, True)


def guarded(schema: type, call: Callable[[], Result]) -> Result:
    """call(), with what it raises as diagnostics."""
    try:
        return call()
    except TableErrors as e:
        return failed(schema, list(e.diagnostics))
    except TableError as e:
        return failed(schema, [as_error(e.diagnostic)])
    except SchemaDefinitionError:
        raise
    except Exception as e:
        return failed(schema, [Diagnostic("internal_error", f"Unexpected failure: {type(e).__name__}", hint=D.HINTS["internal_error"], schema_name=schema.__name__, cause=e)])


def table_hooks(got: Result, data: ParseContext) -> list[tuple]:
    """Rows of what the table's Python hook found, for every table whose records all stand; one table is held at a time."""
    wrong = got.diagnostics.filter((F.col("severity") == D.ERROR) & (F.col("phase") < D.VALIDATION))
    tables = got.all_records.join(wrong.select(F.col("_table_id").alias("_bad")).distinct(), F.col("_table_id") == F.col("_bad"), "left_anti")
    rows = tables.filter(R.no_errors()).orderBy("_table_id", "_ordinal").toLocalIterator()
    out, seen = [], False
    for table, records in itertools.groupby(rows, lambda r: r["_table_id"]):
        seen = True
        more, step = C.run_table_hook(got.plan, build_records(got.plan, records), data)
        out += [(*to_row(d, D.VALIDATION, 2**62, step, i), table) for i, d in enumerate(more)]
    if not seen and got.all_records.isEmpty() and wrong.isEmpty():
        more, step = C.run_table_hook(got.plan, [], data)
        out += [(*to_row(d, D.VALIDATION, 2**62, step, i), "") for i, d in enumerate(more)]
    return out


def strict(schema: type, table: Any, *, context: Any = None, **options: Any) -> Result:
    """A result whose phases end at the first one with an error; the table's Python hook included."""
    data = ParseContext.of(context, schema)
    got = lenient(schema, table, context=data, **options)
    found = got.diagnostics
    if got.plan.hook("validate_records") and (rows := table_hooks(got, data)):
        kinds = T.StructType([*D.DIAGNOSTIC.fields, T.StructField("_table_id", T.StringType())])
        found = found.unionByName(session().createDataFrame(rows, kinds))
    return Result(got.plan, got.all_records, barrier(found), True)


def validate_table(schema: type, table: Any, **options: Any) -> Result:
    """Never raises for what a table holds; records of invalid tables are withheld."""
    return guarded(schema, lambda: strict(schema, table, **options))


MODES = ("first", "collect")


def settled(schema: type, table: Any, error_mode: str, options: dict[str, Any]) -> Result:
    """The strict result of a table without errors; raises otherwise, and emits warnings."""
    if error_mode not in MODES:
        raise ValueError(f"error_mode must be one of {list(MODES)}")
    try:
        got = strict(schema, table, **options)
        ordered = got.ordered()
        rows = (ordered.filter(F.col("severity") == D.ERROR).limit(1) if error_mode == "first" else ordered).collect()
        found = [from_row(r) for r in rows]
        if error_mode == "first" and not found:
            found = [from_row(r) for r in ordered.collect()]
    except (TableError, TableErrors, SchemaDefinitionError):
        raise
    except Exception as e:
        raise TableError(f"Unexpected failure: {type(e).__name__}", schema=schema, code="internal_error", hint=D.HINTS["internal_error"], cause=e) from e
    errors = [d for d in found if d.severity == D.ERROR]
    if errors and error_mode == "first":
        raise TableError.from_diagnostic(errors[0])
    if errors:
        raise TableErrors([TableError.from_diagnostic(d) for d in found])
    C.emit(found)
    return got


def parse_table(schema: type, table: Any, *, error_mode: str = "first", **options: Any) -> DataFrame:
    """The typed records of a valid table as a frame."""
    return settled(schema, table, error_mode, options).records


def parse_records(schema: type, table: Any, *, error_mode: str = "first", **options: Any) -> list[Any]:
    """The records of a valid table as schema instances, in order; for tables that fit the driver."""
    got = settled(schema, table, error_mode, options)
    return build_records(got.plan, got.all_records.filter(R.no_errors()).orderBy("_table_id", "_ordinal").toLocalIterator())


def parse_table_as(schema: type, table: Any, output_model: Any = None, *, error_mode: str = "first", context: Any = None, **options: Any) -> list[Any]:
    """Output objects of a valid table, in order."""
    if output_model is not None and not callable(output_model):
        raise TypeError("output_model must be callable")
    if output_model is None and not has_target(schema.__plan__):
        raise ValueError(f"{schema.__name__} has no output model or builder; give output_model=")
    records = parse_records(schema, table, error_mode=error_mode, context=context, **options)
    return build_outputs(schema.__plan__, records, output_model, ParseContext.of(context, schema), error_mode == "first")


__all__ = ["Converted", "Result", "lenient", "parse_records", "parse_table", "parse_table_as", "strict", "validate_table"]
