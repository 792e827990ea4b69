"""A compiled schema over a record frame: typed values, identity, variants and their diagnostics.

What parsers use more than once is named, level by level (functions.parsed.Binder), so that every cell is taken apart once. Whether a
record is good is a boolean of its own, _ok, over those names: filters on it don't need the diagnostics, which are made for others only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import diagnostics as D
from ..functions.parsed import NO_ERROR, Binder, CellColumns, ParsedExpr
from ..operators.shape import Cell, RecordFrame, as_json, diag
from ..schema import CompiledField, Plan, seal

DIAGS = T.ArrayType(D.DIAGNOSTIC)
#: Columns of a record frame that are not fields.
SYSTEM = ("_table_id", "_ordinal", "_row", "_column", "_uri", "_item", "_variant", "_extras", "_source", "_diag", "_ok")


@dataclass(frozen=True)
class Converted:
    """Records with typed fields, SYSTEM columns, and diagnostics of each record in _diag."""

    plan: Plan
    df: DataFrame
    header: DataFrame | None
    fields: dict[str, T.DataType]


@dataclass(frozen=True)
class Finding:
    """A diagnostic and when it applies."""

    on: Column
    diag: Column


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(c, F.lit(False)) for c in conditions), F.lit(False))


def first_of(found: list[Finding]) -> Column:
    """The first diagnostic that applies, or null."""
    none = F.lit(None).cast(D.DIAGNOSTIC)
    return F.coalesce(*(F.when(x.on, x.diag) for x in found), none) if found else none


def variant_name(value: Any) -> str:
    return str(getattr(value, "name", value))


class Converter:
    def __init__(self, schema: type, frame: RecordFrame, user_data: Any):
        self.plan = seal(schema)
        self.frame, self.user_data = frame, user_data
        self.df = frame.df
        self.binder = Binder("__b")

    def at(self, p: Plan, f: CompiledField, c: Cell, item: Column | None) -> dict[str, Any]:
        uri = F.coalesce(c.uri, F.col("_uri"))
        where = {"uri": uri, "row": c.row, "column": c.column, "source": c.source_value, "logical": c.value}
        return where | {"schema": p.name, "name": f.name, "label": f.label, "item": item, "ordinal": F.col("_ordinal")}

    def parsed(self, f: CompiledField, c: Cell, item: Column) -> ParsedExpr:
        if f.parser is None:
            return ParsedExpr(c.value, NO_ERROR(), T.StringType(), sure=True)
        place = CellColumns(f.name, f.label, c.row, c.column, item, c.source_value, c.uri, self.user_data, self.binder.chain())
        return f.parser.apply(c.value, T.StringType(), place)

    def default(self, p: Plan, f: CompiledField, item: Column, present: Column, where: dict[str, Any]) -> tuple[Column, list[Finding]]:
        """A field's value where its label is missing."""
        at = {"schema": p.name, "name": f.name, "label": f.label, "uri": F.col("_uri"), "item": item, "ordinal": F.col("_ordinal")}
        if f.required:
            missing = diag("missing_required", f"Missing required label {f.label!r}", **at, **where)
            return F.lit(None).cast(f.dtype), [Finding(~present, missing)]
        if f.default_factory is None:
            value = f.literal() if f.has_default else None
            return F.lit(value).cast(f.dtype), []
        place = CellColumns(f.name, f.label, F.col("_row"), F.col("_column"), item, F.lit(None), F.col("_uri"), self.user_data)
        if getattr(f.default_factory, "native", False):
            return f.default_factory(place).cast(f.dtype), []
        from ..hooks import default_udf

        given = F.struct(item.alias("item_id"), F.col("_row").alias("row"), F.col("_column").alias("column"), F.col("_uri").alias("source_uri"))
        name = f"__d_{where['step']}_{where['step_ordinal']}_{f.name}"
        self.df = self.df.withColumn(name, F.when(~present, default_udf(f.default_factory, f.dtype, place)(given)))
        error = F.col(f"{name}.error")
        code = F.coalesce(F.col(f"{name}.code"), F.lit("default_factory_failed"))
        made = diag("default_factory_failed", F.concat(F.lit("Default factory failed: "), error), code_column=code, **at, **where)
        return F.col(f"{name}.value"), [Finding(~present & error.isNotNull(), made)]

    def value(self, p: Plan, f: CompiledField, item: Column, step: int, k: int) -> tuple[Column, list[Finding]]:
        """A field's value and its possible diagnostics."""
        c = self.frame.cell(f.labels)
        present = F.lit(c.present) if isinstance(c.present, bool) else c.present
        where = {"phase": D.CONVERSION, "step": step, "step_ordinal": k}
        missing, out = self.default(p, f, item, present, where) if c.present is not True else (F.lit(None).cast(f.dtype), [])
        if c.present is False:
            return (missing.cast("string") if f.reference is not None else missing), out
        # A null cell of a wide frame counts as blank.
        is_blank = present & (c.value.isNull() | (c.value == ""))
        at = self.at(p, f, c, item)
        if f.policy == "error":
            text = f"{f.label!r} must not be blank" + ("" if f.required else " where it is given")
            out.append(Finding(is_blank, diag("empty_required" if f.required else "empty_optional", text, **at, **where)))
        if f.reference is not None:
            # Keys stay text until they are looked up.
            value = F.when(~present, missing.cast("string")).when(is_blank, F.lit(None)).otherwise(c.value)
            return value.cast("string"), out
        parse_blank = f.policy == "parse" and f.parser is not None
        given = Cell(F.coalesce(c.value, F.lit("")), c.row, c.column, c.source_value, c.uri, c.present) if parse_blank else c
        got = self.parsed(f, given, item)
        if f.parser is not None:
            live = present if parse_blank else present & ~is_blank
            code = got.code if got.code is not None else F.lit(None).cast("string")
            message = F.concat(F.lit(f"Cannot read {f.label!r}: "), got.error)
            out.append(Finding(live & got.failed, diag("parser_failed", message, code_column=F.coalesce(code, F.lit("parser_failed")), **at, **where)))
        blank = F.coalesce(c.value, F.lit("")) if f.policy == "raw" and isinstance(got.dtype, T.StringType) else F.lit(None)
        value = F.when(is_blank, blank.cast(got.dtype)).otherwise(got.value) if not parse_blank else got.value
        return (value if c.present is True else F.when(~present, missing.cast(got.dtype)).otherwise(value)), out

    def run(self) -> Converted:
        plan, frame = self.plan, self.frame
        ends: list[Finding] = []  # diagnostics that end a record
        if frame.ragged is not None:
            text = F.concat(F.lit("Row has "), F.col("_n").cast("string"), F.lit(" cells, the header "), F.col("_w").cast("string"))
            at = {"row": F.col("_row"), "uri": F.col("_uri"), "ordinal": F.col("_ordinal")}
            ends.append(Finding(frame.ragged, diag("ragged_row", text, phase=D.CONVERSION, step=0, schema=plan.name, **at)))
        item = self.identity(ends)
        self.df = self.df.withColumn("_item", item)
        variant = self.variant(F.col("_item"), ends)
        self.df = self.df.withColumn("_variant", variant)

        staged: dict[str, Column] = {}
        bad: list[Column] = []
        found: list[Column] = []
        extras: list[Column] = []
        per_name: dict[str, list[tuple[str | None, CompiledField, Column]]] = {}
        plans = [(None, plan)] if not plan.variants else [(variant_name(v), p) for v, p in plan.variants.items()]
        for n, (v, p) in enumerate(plans):
            mine = F.lit(True) if v is None else F.coalesce(F.col("_variant") == v, F.lit(False))
            if v is not None:
                self.inapplicable(p, mine, extras, found, bad)
            for k, f in enumerate(p.fields.values()):
                if f.is_id or f.is_discriminator:
                    per_name.setdefault(f.name, []).append((v, f, F.col("__id" if f.is_id else "__disc")))
                    continue
                value, own = self.value(p, f, F.col("_item"), 6, k)
                key = f"__v{n}_{k}"
                staged[key] = F.when(mine, value)
                bad += [mine & x.on for x in own]
                if own:
                    found.append(F.when(mine, first_of(own)))
                per_name.setdefault(f.name, []).append((v, f, F.col(key)))
        staged["__ended"] = any_of([x.on for x in ends])
        staged["_ok"] = ~any_of([x.on for x in ends] + bad)
        self.df = self.binder.apply(self.df).withColumns(staged)

        values: dict[str, Column] = {}
        kinds: dict[str, T.DataType] = {}
        for name, got in per_name.items():
            types = {(T.StringType() if f.reference is not None else f.dtype).simpleString() for _, f, _ in got}
            if len(types) == 1:
                values[name] = F.coalesce(*(c for _, _, c in got)) if len(got) > 1 else got[0][2]
                kinds[name] = got[0][1].dtype
            else:
                values[name] = F.struct(*(c.alias(str(v)) for v, _, c in got))
                kinds[name] = T.StructType([T.StructField(str(v), f.dtype) for v, f, _ in got])
        fields = F.array_compact(F.array(*found)) if found else F.array().cast(DIAGS)
        diags = F.when(F.col("_ok"), F.array().cast(DIAGS)).when(F.col("__ended"), F.array(first_of(ends))).otherwise(fields)
        kept = F.map_from_entries(F.array_compact(F.array(*extras))) if extras else F.lit(None).cast("map<string,string>")
        place = (F.col(f"_{n}").alias(m) for n, m in (("item", "item_id"), ("row", "row"), ("column", "column"), ("uri", "source_uri")))
        source = F.struct(*place, frame.all_cells().alias("cells"))
        own = [kept.alias("_extras"), source.alias("_source"), diags.alias("_diag"), "_ok", *(c.alias(n) for n, c in values.items())]
        out = self.df.select("_table_id", "_ordinal", "_row", "_column", "_uri", "_item", "_variant", *own)
        return Converted(plan, out, frame.header, kinds)

    def identity(self, ends: list[Finding]) -> Column:
        """The record's id as JSON text; its failures are added to ends, and the id itself is the column __id."""
        plan, frame = self.plan, self.frame
        if (f := plan.id) is None:
            return F.lit(None).cast("string")
        c = frame.cell(f.labels)
        # In its own errors a record is named by the id's text.
        raw = as_json(c.value) if c.present is not False else F.lit(None).cast("string")
        raw = F.when(raw != "null", raw)
        value, found = self.value(plan, f, raw, 1, 0)
        self.df = self.binder.apply(self.df).withColumns({"__id": value, "__id_bad": any_of([x.on for x in found])})
        ends.append(Finding(F.col("__id_bad"), first_of(found)))
        if isinstance(f.dtype, (T.ArrayType, T.MapType)):
            plain = diag("invalid_id", "An id must be a plain value", phase=D.CONVERSION, step=2, **self.at(plan, f, c, raw))
            ends.append(Finding(F.col("__id").isNotNull(), plain))
            return F.to_json("__id")
        skipped = F.coalesce(frame.ragged, F.lit(False)) if frame.ragged is not None else F.lit(False)
        self.df = self.mark_duplicates(self.df, skipped)
        item = F.when(F.col("__id").isNotNull(), as_json(F.col("__id")))
        ends.append(Finding(F.col("__again"), diag("duplicate_id", F.concat(F.lit("Duplicate id "), item), phase=D.CONVERSION, step=3, **self.at(plan, f, c, item))))
        return item

    def variant(self, item: Column, ends: list[Finding]) -> Column:
        """The name of the record's variant; failures are added to ends, and the discriminator itself is the column __disc."""
        plan = self.plan
        variant = F.lit(None).cast("string")
        if (f := plan.discriminator) is None:
            return variant
        value, found = self.value(plan, f, item, 4, 0)
        self.df = self.binder.apply(self.df).withColumns({"__disc": value, "__disc_bad": any_of([x.on for x in found])})
        for v in reversed(plan.variants):
            key = v.name if hasattr(v, "name") and hasattr(v, "value") else v
            variant = F.when(F.col("__disc") == F.lit(key), F.lit(str(key))).otherwise(variant)
        choices = ", ".join(repr(getattr(v, "name", v)) for v in plan.variants)
        unknown = ~F.col("__disc_bad") & F.col("__disc").isNotNull() & F.col("_variant").isNull()
        at = self.at(plan, f, self.frame.cell(f.labels), item)
        ends.append(Finding(F.col("__disc_bad"), first_of(found)))
        ends.append(Finding(unknown, diag("unknown_variant", f"Unknown variant; expected one of {choices}", phase=D.CONVERSION, step=4, **at)))
        return variant

    def inapplicable(self, p: Plan, mine: Column, extras: list[Column], found: list[Column], bad: list[Column]) -> None:
        """Cells of labels that other variants have: kept in extras, or diagnostics."""
        own = {x for f in p.fields.values() for x in f.labels}
        for k, label in enumerate(x for x in self.plan.labels() if x not in own):
            c = self.frame.cell((label,))
            if c.present is False:
                continue
            used = mine & c.value.isNotNull() & (c.value != "")
            if p.inapplicable == "preserve":
                extras.append(F.when(used, F.struct(F.lit(label).alias("k"), c.value.alias("v"))))
                continue
            at = {"uri": F.col("_uri"), "row": c.row, "column": c.column, "source": c.source_value, "logical": c.value}
            at |= {"schema": p.name, "label": label, "item": F.col("_item"), "ordinal": F.col("_ordinal")}
            bad.append(used)
            text = f"{label!r} does not apply to {p.name}"
            found.append(F.when(used, diag("inapplicable_field", text, phase=D.CONVERSION, step=5, step_ordinal=k, **at)))

    @staticmethod
    def mark_duplicates(df: DataFrame, skipped: Column) -> DataFrame:
        """df with __again: whether an earlier record of the table has the id.

        Ids are counted before the join, so a shuffle of whole records is needed only where repeated ids are too many to broadcast.
        """
        good = ~F.col("__id_bad") & F.col("__id").isNotNull() & ~skipped
        counts = df.filter(good).groupBy("_table_id", "__id").agg(F.count("*").alias("__n"), F.min("_ordinal").alias("__first"))
        often = counts.filter("__n > 1").select(F.col("_table_id").alias("__t"), F.col("__id").alias("__k"), "__first")
        joined = df.join(often, (F.col("_table_id") == F.col("__t")) & (F.col("__id") == F.col("__k")), "left")
        again = good & F.col("__k").isNotNull() & (F.col("_ordinal") > F.col("__first"))
        return joined.withColumn("__again", F.coalesce(again, F.lit(False))).drop("__t", "__k", "__first")


def convert(schema: type, frame: RecordFrame, user_data: Any = None) -> Converted:
    return Converter(schema, frame, user_data).run()
