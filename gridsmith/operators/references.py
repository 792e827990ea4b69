"""References between records of one table: keys looked up among the target field's values.

Targets are a narrow table of (table, key); keys are joined to it, so Spark chooses the strategy by size and splits skewed keys. Lists
of keys are exploded, joined and gathered again for each record, so they need an ordinal that tells records apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import diagnostics as D
from ..functions.parsed import Parser
from ..functions.parsers import identity, literal_regex, strip
from ..plans.records import DIAGS, Converted
from ..schema import CompiledField, Plan
from .shape import as_json, diag


#: Ambiguous targets are reported before any lookup.
AHEAD = 1 << 40


def no_errors() -> F.Column:
    return F.col("_ok")


def reference_fields(plan: Plan) -> list[tuple[CompiledField, Plan, list[str]]]:
    """Each reference, a plan that has it, and the variants that do (none: all records)."""
    out: dict[str, tuple[CompiledField, Plan, list[str]]] = {}
    for v, p in plan.variants.items() if plan.variants else [(None, plan)]:
        for f in p.fields.values():
            if f.reference is not None:
                out.setdefault(f.name, (f, p, []))[2].extend([] if v is None else [str(getattr(v, "name", v))])
    return list(out.values())


def target_of(plan: Plan, name: str) -> tuple[CompiledField, list[str]]:
    """The target field and the variants that have it."""
    if not plan.variants:
        return plan.fields[name], []
    having = [(str(getattr(v, "name", v)), p.fields[name]) for v, p in plan.variants.items() if name in p.fields]
    return having[0][1], [v for v, _ in having]


def resolve(c: Converted) -> tuple[Converted, DataFrame | None]:
    """Typed keys in place of their text, lookups that fail in _diag, and the diagnostics of ambiguous targets."""
    found = reference_fields(c.plan)
    if not found:
        return c, None
    df, ambiguous = c.df, None
    base = df
    # Whether a record was good before any reference was looked up.
    df = df.withColumn("__ok", no_errors())
    bad_targets: dict[str, DataFrame] = {}
    for target in dict.fromkeys(f.reference.target for f, _, _ in found):
        rows, bad_targets[target] = ambiguities(c.plan, base, target)
        ambiguous = rows if ambiguous is None else ambiguous.unionByName(rows)
    for k, (f, p, _) in enumerate(found):
        t, variants = target_of(c.plan, f.reference.target)
        parser: Parser = t.parser or identity()
        keys = good_targets(base, variants).select(F.col("_table_id").alias("__t"), F.col(f"`{t.name}`").alias("__k"))
        keys = keys.filter("__k IS NOT NULL").distinct()
        df = (many if f.reference.many else single)(df, f, p, parser, keys, bad_targets[f.reference.target], k)
    return Converted(c.plan, df.drop("__ok"), c.header, c.fields), ambiguous


def good_targets(base: DataFrame, variants: list[str]) -> DataFrame:
    good = base.filter(no_errors())
    return good.filter(F.col("_variant").isin(variants)) if variants else good


def ambiguities(plan: Plan, base: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """The diagnostics of values that several records have, at the second of each, and the tables (__bt) that have any."""
    t, variants = target_of(plan, target)
    index = good_targets(base, variants).select("_table_id", "_ordinal", F.col(f"`{target}`").alias("__key"), "_source")
    often = index.groupBy("_table_id", "__key").agg(F.count("*").alias("n"), F.min("_ordinal").alias("first")).filter("n > 1")
    same = (F.col("i._table_id") == F.col("o._table_id")) & F.col("i.__key").eqNullSafe(F.col("o.__key"))
    again = index.alias("i").join(often.alias("o"), same & (F.col("i._ordinal") > F.col("o.first"))).select("i.*")
    second = again.groupBy("_table_id", "__key").agg(F.min_by(F.struct("_ordinal", "_source"), "_ordinal").alias("x"))
    cell = F.coalesce(*(F.try_element_at("x._source.cells", F.lit(x)) for x in t.labels))
    made = diag(
        "reference_failed",
        F.concat(F.lit(f"The reference target {target!r} is not unique: "), as_json(F.col("__key"))),
        phase=D.REFERENCES,
        step=0,
        schema=plan.name,
        name=target,
        label=t.label,
        ordinal=F.col("x._ordinal") - F.lit(AHEAD),
        row=F.coalesce(cell["source_row"], F.col("x._source.row")),
        column=F.coalesce(cell["source_column"], F.col("x._source.column")),
        uri=F.col("x._source.source_uri"),
        item=F.col("x._source.item_id"),
        source=cell["source_value"],
    )
    rows = second.select("_table_id", made.alias("d")).select("_table_id", "d.*")
    return rows, often.select(F.col("_table_id").alias("__bt")).distinct()


def failure(f: CompiledField, p: Plan, key: F.Column, error: F.Column, k: int, place: F.Column | None = None) -> F.Column:
    """The diagnostic of a key that can't be read or that no record has."""
    cell = F.coalesce(*(F.try_element_at("_source.cells", F.lit(x)) for x in f.labels))
    unread = F.concat(F.lit("Reference key conversion failed: "), error)
    unknown = F.concat(F.lit(f"No record with {f.reference.target} "), as_json(key))
    return diag(
        "reference_failed",
        F.when(error.isNotNull(), unread).otherwise(unknown),
        phase=D.REFERENCES,
        step=1 + k,
        step_ordinal=place if place is not None else 0,
        schema=p.name,
        name=f.name,
        label=f.label,
        ordinal=F.col("_ordinal"),
        row=cell["source_row"],
        column=cell["source_column"],
        uri=F.coalesce(cell["source_uri"], F.col("_uri")),
        item=F.col("_item"),
        source=cell["source_value"],
        logical=cell["value"],
    )


def single(df: DataFrame, f: CompiledField, p: Plan, parser: Parser, keys: DataFrame, bad: DataFrame, k: int) -> DataFrame:
    name = f"`{f.name}`"
    text = F.when(F.col("__ok") & (F.col(name) != ""), F.col(name))
    got = parser.apply(text, T.StringType(), None)
    df = df.withColumns({"__text": text, "__kv": got.value, "__ke": F.when(text.isNotNull(), got.error)})
    df = df.join(bad, F.col("_table_id") == F.col("__bt"), "left")
    df = df.join(keys, (F.col("_table_id") == F.col("__t")) & (F.col("__kv") == F.col("__k")), "left")
    failed = F.col("__text").isNotNull() & F.col("__k").isNull() & F.col("__bt").isNull()
    found = F.array(failure(f, p, F.col("__text"), F.col("__ke"), k))
    own = {
        "_diag": F.when(failed, F.concat("_diag", found)).otherwise(F.col("_diag")),
        "_ok": F.col("_ok") & ~F.coalesce(failed, F.lit(False)),
        f.name: F.col("__k"),
    }
    return df.withColumns(own).drop("__text", "__kv", "__ke", "__bt", "__t", "__k")


def many(df: DataFrame, f: CompiledField, p: Plan, parser: Parser, keys: DataFrame, bad: DataFrame, k: int) -> DataFrame:
    name = f"`{f.name}`"
    parts = F.transform(F.split(F.col(name), literal_regex(f.reference.separator), -1), strip)
    text = df.filter(F.col("__ok") & F.col(name).isNotNull() & (F.col(name) != ""))
    spread = text.select("_table_id", "_ordinal", F.posexplode(parts).alias("__p", "__x"))
    got = parser.apply(F.col("__x"), T.StringType(), None)
    spread = spread.withColumns({"__kv": got.value, "__ke": got.error})
    looked = spread.join(keys, (F.col("_table_id") == F.col("__t")) & (F.col("__kv") == F.col("__k")), "left")
    # Gathered by record: a record's own keys, in their order.
    lists = F.sort_array(F.collect_list(F.struct("__p", "__x", "__ke", "__k"))).alias("__all")
    back = looked.groupBy(F.col("_table_id").alias("__rt"), F.col("_ordinal").alias("__ro")).agg(lists)
    df = df.join(bad, F.col("_table_id") == F.col("__bt"), "left")
    df = df.join(back, (F.col("_table_id") == F.col("__rt")) & (F.col("_ordinal") == F.col("__ro")), "left")
    wrong = F.filter("__all", lambda x: x["__k"].isNull())
    made = F.transform(wrong, lambda x: failure(f, p, x["__x"], x["__ke"], k, x["__p"]))
    lost = F.coalesce(F.size(wrong) > 0, F.lit(False)) & F.col("__bt").isNull()
    none = F.array().cast(T.ArrayType(parser.dtype))
    whole = (F.size(wrong) == 0) & F.col("__bt").isNull()
    own = {
        "__value": F.when(F.col("__all").isNull() & F.col("__ok"), none).when(whole, F.transform("__all", lambda x: x["__k"])),
        "_ok": F.col("_ok") & ~lost,
        "_diag": F.when(lost, F.concat("_diag", made)).otherwise(F.col("_diag")).cast(DIAGS),
    }
    return df.withColumns(own).withColumn(f.name, F.col("__value")).drop("__value", "__bt", "__rt", "__ro", "__all")
