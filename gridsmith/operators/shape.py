"""Orientation: wide frames and cells as record frames, with the diagnostics of their headers.

A record frame has _table_id, _ordinal (the record's place), _row, _column, _uri and the record's cells. In a wide frame labels are
columns and cells are read by name at planning time; records of cells carry a map from label to cell.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import diagnostics as D
from ..diagnostics import Diagnostic, TableError, to_row
from ..schema import COLUMN, Plan
from ..sources.cells import CELL, CellFrame


def diag(
    code: str,
    message: Column | str,
    *,
    phase: int,
    step: int,
    step_ordinal: Any = 0,
    ordinal: Column | None = None,
    schema: str | None = None,
    name: str | None = None,
    label: Column | str | None = None,
    uri: Column | None = None,
    row: Column | None = None,
    column: Column | None = None,
    item: Column | None = None,
    source: Column | None = None,
    logical: Column | None = None,
    severity: str = D.ERROR,
    code_column: Column | None = None,
) -> Column:
    """A diagnostic as a struct column; item is JSON text, source and logical are text values."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    values = {
        "diagnostic_version": 1,
        "severity": severity,
        "code": code_column if code_column is not None else code,
        "message": message,
        "hint": D.HINTS.get(code),
        "schema_name": schema,
        "field_name": name,
        "field_label": label,
        "source_uri": uri,
        "row": row,
        "column": column,
        "has_item_id": item.isNotNull() if item is not None else False,
        "item_id": item,
        "has_source_value": source is not None,
        "source_value": as_json(source) if source is not None else None,
        "has_logical_value": logical is not None,
        "logical_value": as_json(logical) if logical is not None else None,
        "phase": phase,
        "record_ordinal": ordinal if ordinal is not None else 0,
        "step": step,
        "step_ordinal": step_ordinal,
    }
    return F.struct(*(as_column(values[f.name]).cast(f.dataType).alias(f.name) for f in D.DIAGNOSTIC.fields))


def as_json(c: Column) -> Column:
    """A plain value as JSON text; null is JSON's null."""
    text = F.to_json(F.array(c))
    return F.coalesce(F.substring(text, F.lit(2), F.length(text) - 2), F.lit("null"))


@dataclass(frozen=True)
class Cell:
    value: Column
    row: Column
    column: Column
    source_value: Column
    uri: Column
    present: Column | bool  # a bool where it is known at planning time


@dataclass(frozen=True)
class RecordFrame:
    df: DataFrame
    header: DataFrame | None  # diagnostics of headers and shapes, DIAGNOSTIC columns and _table_id
    wide: dict[str, str] | None = None  # label -> column, for wide frames
    ragged: Column | None = None
    count: Column | None = None
    labels: list[str] = field(default_factory=list)

    def cell(self, labels: tuple[str, ...]) -> Cell:
        if self.wide is not None:
            found = next((x for x in labels if x in self.wide), None)
            if found is None:
                none = F.lit(None)
                return Cell(none.cast("string"), none.cast("int"), none.cast("int"), none.cast("string"), F.col("_uri"), False)
            c = F.col(f"`{self.wide[found]}`").cast("string")
            return Cell(c, F.col("_row"), F.lit(self.labels.index(found) + 1), c, F.col("_uri"), True)
        cells = F.col("_cells")
        got = F.coalesce(*(F.try_element_at(cells, F.lit(x)) for x in labels))
        return Cell(got["value"], got["source_row"], got["source_column"], got["source_value"], got["source_uri"], got.isNotNull())

    def all_cells(self) -> Column:
        """Every cell of the record by its label."""
        if self.wide is None:
            return F.col("_cells")
        pairs = []
        for label in self.wide:
            c = self.cell((label,))
            parts = zip((c.value, c.row, c.column, c.source_value, c.uri), CELL.fields)
            pairs += [F.lit(label), F.struct(*(v.cast(f.dataType).alias(f.name) for v, f in parts))]
        return F.create_map(*pairs) if pairs else F.create_map().cast(T.MapType(T.StringType(), CELL))


def header_findings(plan: Plan, labels: list[str]) -> list[tuple[str, str, str, int, int]]:
    """(code, message, label, step, place) for a header known on the driver, places from 0 on."""
    out, known = [], set(plan.labels())
    for i, x in enumerate(labels):
        if x in labels[:i]:
            out.append(("duplicate_label", f"The label {x!r} is used more than once", x, 0, i))
    for i, x in enumerate(labels):
        if x not in known:
            out.append(("unknown_field", f"Unknown label {x!r}", x, 1, i))
    for k, p in enumerate(plan.family):
        for f in p.fields.values():
            used = [x for x in labels if x in f.labels]
            if len(set(used)) > 1:
                at = max(labels.index(x) for x in set(used))
                several = " and ".join(repr(x) for x in dict.fromkeys(used))
                out.append(("duplicate_label", f"The field {f.name!r} is given by {several}", labels[at], 2, k * 10_000 + at))
    return out


def needs_ordinal(plan: Plan) -> str | None:
    """Why a frame, whose rows have no order, must number them for this plan; None where it need not."""
    if plan.id is not None:
        return f"of records with one {plan.id.label!r} the first is kept"
    if any(f.reference is not None for p in plan.family for f in p.fields.values()):
        return "references tell records apart"
    if any(getattr(c, "looks_at_order", False) for c in plan.checks):
        return "of records with equal values the later ones are reported"
    return None


def from_wide(df: DataFrame, plan: Plan, *, ordinal: str | None, uri: str | None, table_id: str | None) -> RecordFrame:
    """Every row of a frame is a record; its columns, other than those named here, are labels."""
    special = {c for c in (ordinal, table_id) if c}
    names = [c for c in df.columns if c not in special]
    # Columns of equal names are told apart by place; only the first is read, and the others are reported.
    renamed = df
    if len(set(names)) < len(names):
        fresh = [f"__c{i}" if c not in special else c for i, c in enumerate(df.columns)]
        renamed = df.toDF(*fresh)
        wide = {}
        for c, n in zip(df.columns, fresh):
            if c not in special:
                wide.setdefault(c, n)
    else:
        wide = {c: c for c in names}
    if ordinal is None and (why := needs_ordinal(plan)):
        raise TableError(f"{why}: name the column that numbers the rows by ordinal=", schema=plan.schema, code="invalid_table_input")
    findings = header_findings(plan, names)
    rows = []
    for code, message, label, step, i in findings:
        at = {"schema_name": plan.name, "field_label": label, "source_uri": uri, "column": i % 10_000 + 1, "_source_value": label}
        d = Diagnostic(code, message, hint=D.HINTS.get(code), **at)
        rows.append(to_row(d, D.CONVERSION, 0, step, i))
    header = None
    if rows and table_id is None:
        header = df.sparkSession.createDataFrame(rows, D.DIAGNOSTIC).withColumn("_table_id", F.lit(""))
    elif rows:
        # All tables of the frame share its header, so each of them has its findings.
        tables = renamed.select(F.col(f"`{table_id}`").cast("string").alias("_table_id")).distinct()
        each = F.array(*(F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, D.DIAGNOSTIC.fields))) for r in rows))
        header = tables.select("_table_id", F.explode(each).alias("d")).select("_table_id", "d.*")
    place = F.col(f"`{ordinal}`").cast("bigint") if ordinal else F.lit(None).cast("bigint")
    own = {
        "_table_id": F.col(f"`{table_id}`").cast("string") if table_id else F.lit(""),
        "_ordinal": place,
        "_row": place.try_cast("int"),
        "_column": F.lit(None).cast("int"),
        "_uri": F.lit(uri).cast("string"),
    }
    out = renamed.withColumns(own)
    return RecordFrame(out, header, wide, labels=names)


def gathered(place: str, name: str) -> Column:
    """An aggregate: the cells of a group as structs (i: their place, c: the cell), in order."""
    cell = F.struct(*(F.col(f.name) for f in CELL.fields))
    return F.sort_array(F.collect_list(F.struct(F.col(place).alias("i"), cell.alias("c")))).alias(name)


def located(x: Column) -> dict[str, Column]:
    """The place and values of a gathered cell, as diagnostics name them."""
    c = x["c"]
    return {"row": c["source_row"], "column": c["source_column"], "uri": c["source_uri"], "label": c["value"], "source": c["source_value"], "logical": c["value"]}


def from_cells(cells: CellFrame, plan: Plan) -> RecordFrame:
    """Records of cells, any number of tables. Rows of a table are dealt by (table, record), so one table may be of any size."""
    column_mode = plan.orientation == COLUMN
    rec, lab = ("col_idx", "row_idx") if column_mode else ("row_idx", "col_idx")
    df = cells.df
    head = df.filter(F.col(rec) == 1).groupBy("table_id").agg(gathered(lab, "_labels"))
    body = df.filter(F.col(rec) > 1).groupBy("table_id", rec).agg(gathered(lab, "_row_cells"), F.max("source_uri").alias("_uri"))
    texts = F.transform("_labels", lambda x: x["c"]["value"])
    # Each label with the record's cell at its place; of equal labels only the first is read.
    numbers = F.sequence(F.lit(1), F.greatest(F.size("_labels"), F.size("_row_cells")))
    zipped = F.arrays_zip(texts.alias("l"), F.transform("_row_cells", lambda x: x["c"]).alias("c"), numbers.alias("n"))
    used = F.filter(zipped, lambda e: e["l"].isNotNull() & e["c"].isNotNull() & (F.array_position(texts, e["l"]) == e["n"]))
    own = body.join(head, "table_id").withColumns(
        {
            "_cells": F.map_from_entries(F.transform(used, lambda e: F.struct(e["l"], e["c"]))),
            "_n": F.size("_row_cells"),
            "_w": F.size("_labels"),
            "_first": F.get("_row_cells", F.lit(0))["c"],
        }
    )
    none = F.lit(None).cast("int")
    records = own.select(
        F.col("table_id").alias("_table_id"),
        (F.col(rec) - 1).cast("bigint").alias("_ordinal"),
        (none if column_mode else F.col("_first.source_row")).alias("_row"),
        (F.col("_first.source_column") if column_mode else none).alias("_column"),
        "_uri",
        "_cells",
        (F.lit(False) if column_mode else F.col("_n") != F.col("_w")).alias("_ragged"),
        "_n",
        "_w",
    )
    counts = df.groupBy("table_id").agg(F.max(rec).alias("_m"), F.max("source_uri").alias("_u"))
    found = F.concat(*label_findings(plan, texts), *missing_labels(plan, texts), *([first_label(plan)] if column_mode else []))
    header = head.join(counts, "table_id").select(F.col("table_id").alias("_table_id"), F.explode(found).alias("d")).select("_table_id", "d.*")
    if column_mode:
        header = header.unionByName(ragged_rows(df, plan))
    return RecordFrame(records, header, None, F.col("_ragged"))


def label_findings(plan: Plan, texts: Column) -> list[Column]:
    """Lists of diagnostics of a header's labels: used twice, unknown, and several of one field."""
    names = F.array(*(F.lit(x) for x in plan.labels())).cast("array<string>")
    where = {"phase": D.CONVERSION, "schema": plan.name}

    def again(x: Column) -> Column:
        text = F.concat(F.lit("The label '"), x["c"]["value"], F.lit("' is used more than once"))
        return diag("duplicate_label", text, step=0, step_ordinal=x["i"], **where, **located(x))

    def unknown(x: Column) -> Column:
        text = F.concat(F.lit("Unknown label '"), x["c"]["value"], F.lit("'"))
        return diag("unknown_field", text, step=1, step_ordinal=x["i"], **where, **located(x))

    def clash(p: Plan, f: Any, k: int) -> Column:
        used = F.filter("_labels", lambda x: x["c"]["value"].isin(list(f.labels)))
        several = F.size(F.array_distinct(F.transform(used, lambda x: x["c"]["value"]))) > 1
        at = {"phase": D.CONVERSION, "schema": p.name, "name": f.name, "step": 2}
        text = f"The field {f.name!r} is given by several labels"
        made = F.transform(F.slice(used, -1, 1), lambda x: diag("duplicate_label", text, step_ordinal=x["i"] + k * 10_000, **at, **located(x)))
        return F.when(several, made).otherwise(F.array().cast(T.ArrayType(D.DIAGNOSTIC)))

    out = [
        F.transform(F.filter("_labels", lambda x: F.array_position(texts, x["c"]["value"]) < x["i"]), again),
        F.transform(F.filter("_labels", lambda x: ~F.array_contains(names, x["c"]["value"])), unknown),
    ]
    return out + [clash(p, f, k) for k, p in enumerate(plan.family) for f in p.fields.values() if f.aliases]


def missing_labels(plan: Plan, texts: Column) -> list[Column]:
    """Of a table without records: required labels that its header lacks, which no record could tell."""
    out = []
    for i, f in enumerate(f for f in plan.fields.values() if f.required):
        lacking = (F.col("_m") == 1) & ~F.arrays_overlap(texts, F.array(*(F.lit(x) for x in f.labels)))
        at = {"phase": D.CONVERSION, "step": 3, "step_ordinal": i, "schema": plan.name, "name": f.name, "label": f.label, "uri": F.col("_u")}
        out.append(F.array_compact(F.array(F.when(lacking, diag("missing_required", f"Missing required label {f.label!r}", **at)))))
    return out


def first_label(plan: Plan) -> Column:
    """Of a table of columns: its first row must hold the ids."""
    top = F.get("_labels", F.lit(0))
    wrong = ~top["c"]["value"].isin(list(plan.id.labels))
    made = diag("invalid_id", f"The first row must hold {plan.id.label!r}", phase=D.INPUT, step=0, schema=plan.name, name=plan.id.name, **located(top))
    return F.array_compact(F.array(F.when(wrong, made)))


def ragged_rows(df: DataFrame, plan: Plan) -> DataFrame:
    """Diagnostics of a table of columns whose rows are not all as long as its first."""
    rows = df.groupBy("table_id", "row_idx").agg(F.count("*").alias("n"), F.min("source_row").alias("r"), F.max("source_uri").alias("u"))
    width = rows.filter("row_idx = 1").select("table_id", F.col("n").alias("w"))
    text = F.concat(F.lit("Row has "), F.col("n").cast("string"), F.lit(" cells, the first row "), F.col("w").cast("string"))
    made = diag("ragged_row", text, phase=D.INPUT, step=1, step_ordinal=F.col("row_idx"), schema=plan.name, row=F.col("r"), uri=F.col("u"))
    return rows.join(width, "table_id").filter("n != w").select(F.col("table_id").alias("_table_id"), made.alias("d")).select("_table_id", "d.*")
