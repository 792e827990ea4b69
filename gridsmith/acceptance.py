"""Queries for what the frames of queries.py don't reach: sources, sinks, compile-time rules, hooks, outputs, the command line.

Each makes its tables of the driver's own (regions, nations, suppliers, orders, ...) and gives codes, counts or values as a frame.
"""

from __future__ import annotations

import contextlib
import dataclasses
import io
import json
import tempfile
import warnings
from collections.abc import Callable, Sequence
from enum import Enum
from pathlib import Path
from types import SimpleNamespace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, cli
from .checker import check_feature_tables, check_files
from .diagnostics import Diagnostic, TableError, TableErrors, TableWarning
from .fields import discriminator, discriminator_field, field, id_field, reference
from .functions import parsers as P
from .operators.checks import unique
from .operators.groups import ColumnGroupExpander
from .pytest_plugin import TableParser, pytest_bdd_before_step_call
from .queries import QUERIES, REGION, SQL, EventType, Regions, counts, keyed, one, query, read, region_rows, transposed
from .schema import ColumnTable, Fields, RowTable
from .sources.cells import CellFrame, TableCell
from .sources.features import cells_of, discover_feature_tables, feature_tables

__all__ = ["QUERIES", "SQL"]


def values(*rows: tuple, names: str) -> str:
    """SQL for literal rows."""
    literal = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else f"'{x}'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({names})"


def outcome(call: Callable[[], Any]) -> str:
    """What a call raises, by name; 'none' if it doesn't."""
    try:
        call()
    except Exception as e:
        return type(e).__name__
    return "none"


def outcomes(spark: SparkSession, cases: dict[str, Callable[[], Any]]) -> DataFrame:
    return spark.createDataFrame([(k, outcome(f)) for k, f in cases.items()], "rule string, outcome string")


def codes(result: api.Result) -> list[str]:
    return [d.code for d in result.collect_diagnostics()]


def made(base: type = RowTable, **space: Any) -> type:
    """A schema declared on the spot."""
    annotations = space.pop("annotations", {})
    return type(base)("Made", (base,), {"__module__": __name__, "__annotations__": annotations} | space)


def regions(spark: SparkSession, sf: str) -> list[list[str]]:
    """The five regions as literal rows under a header."""
    rows = read(spark, sf, "region").orderBy("r_regionkey").collect()
    return [["key", "name"], *([str(r["r_regionkey"]), r["r_name"]] for r in rows)]


# Sources and sinks.


@query("s01_raw_rows", REGION)
def s01_raw_rows(spark, sf):
    return api.lenient(Regions, regions(spark, sf)).records.select("key", "name")


@query("s03_ensure", "SELECT k AS source, 2 * (count(*) + 1) AS cells FROM region, (VALUES ('rows'), ('pandas'), ('cells'), ('frame')) t(k) GROUP BY k")
def s03_ensure(spark, sf):
    rows = regions(spark, sf)
    own = region_rows(spark, sf)
    sources = {"rows": rows, "pandas": pd.DataFrame(rows[1:], columns=rows[0]), "cells": own, "frame": own.df}
    frames = [CellFrame.ensure(x).df.agg(F.count("*").alias("cells")).select(F.lit(k).alias("source"), "cells") for k, x in sources.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


def nation_features(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content): a feature file for each region, with its nations as a step's table, an outline and a rule."""
    n = read(spark, sf, "nation").join(read(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("      | "), x["n_nationkey"].cast("string"), F.lit(" | "), x["n_name"], F.lit(" |"))), "\n")
    each = n.groupBy("r_name").agg(lines.alias("lines"))
    head = F.concat(F.lit("Feature: "), F.col("r_name"), F.lit("\n  Background: all\n    Given the nations:\n      | key | name |\n"), F.col("lines"))
    tail = F.concat(F.lit("\n  Scenario Outline: each\n    When one nation:\n      | key | name |\n      | <k> | no. <k> |\n    Examples:\n      | k | name |\n"), F.col("lines"), F.lit("\n  Rule: last\n    Scenario: end\n      Then a note:\n        | key | name |\n        | 0 | x |\n"))
    return each.select(F.concat(F.lit("mem:"), F.col("r_name"), F.lit(".feature")).alias("path"), F.concat(head, tail).alias("content"))


class FeatureNations(RowTable):
    key = field("key", required=True, parser=P.integer())
    name = field("name", required=True)


NATION = "SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation"


@query("s04_feature_scan", NATION)
def s04_feature_scan(spark, sf):
    cells = feature_tables(nation_features(spark, sf), step="the nations:")
    return api.lenient(FeatureNations, cells_of(cells)).records.select("key", "name")


@query("s05_scenarios", "SELECT r_name AS feature, scenario, step, n FROM region, (SELECT n_regionkey, count(*) AS c FROM nation GROUP BY 1), LATERAL (VALUES ('all', 'the nations:', 1), ('each', 'one nation:', c), ('end', 'a note:', 1)) t(scenario, step, n) WHERE n_regionkey = r_regionkey")
def s05_scenarios(spark, sf):
    found = feature_tables(nation_features(spark, sf))
    return found.groupBy("feature", "scenario", "step").agg(F.count_distinct("table_id").alias("n"))


@query("s06_outline", "SELECT n_nationkey::BIGINT AS key, 'no. ' || n_nationkey AS name, 'no. <k>' AS written FROM nation")
def s06_outline(spark, sf):
    cells = cells_of(feature_tables(nation_features(spark, sf), scenario="each"))
    return api.lenient(FeatureNations, cells).records.select("key", "name", F.col("_source.cells")["name"]["source_value"].alias("written"))


@query("s07_coordinates", "SELECT n_nationkey::BIGINT AS key, (4 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INTEGER AS line, 9 AS first_column, 9 + length(n_nationkey::VARCHAR) + 3 AS second_column FROM nation")
def s07_coordinates(spark, sf):
    got = api.lenient(FeatureNations, cells_of(feature_tables(nation_features(spark, sf), step="the nations:"))).records
    cell = lambda n: F.col("_source.cells")[n]
    return got.select("key", cell("key")["source_row"].alias("line"), cell("key")["source_column"].alias("first_column"), cell("name")["source_column"].alias("second_column"))


@query("s08_provenance", "SELECT n_nationkey::BIGINT AS key, 'mem:' || r_name || '.feature' AS uri FROM nation JOIN region ON n_regionkey = r_regionkey")
def s08_provenance(spark, sf):
    got = api.lenient(FeatureNations, cells_of(feature_tables(nation_features(spark, sf), step="the nations:"))).records
    return got.select("key", F.col("_source.source_uri").alias("uri"))


@query("f14_filters", "SELECT 'step' AS filter, count(*) AS n FROM nation UNION ALL SELECT 'scenario', count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'neither', 0")
def f14_filters(spark, sf):
    files = nation_features(spark, sf)
    found = {"step": {"step": "the nations:"}, "scenario": {"scenario": "end"}, "neither": {"step": "The nations"}}
    frames = [feature_tables(files, **w).filter("row_idx > 1 AND col_idx = 1").agg(F.count("*").alias("n")).select(F.lit(k).alias("filter"), "n") for k, w in found.items()]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


class Numbered(RowTable):
    key = field("key", required=True, parser=P.integer())
    name = field("name", required=True, parser=P.integer())


@query("s09_step_binding", "SELECT 'parser_failed' AS code, (31 + r_regionkey)::INTEGER AS line, 17 AS place, 'steps.feature' AS uri FROM region")
def s09_step_binding(spark, sf):
    rows, parser = regions(spark, sf), TableParser()
    at = lambda line, column: SimpleNamespace(location=SimpleNamespace(line=line, column=column))
    step = SimpleNamespace(datatable=SimpleNamespace(rows=[SimpleNamespace(cells=[at(30 + i, 9), at(30 + i, 17)]) for i in range(len(rows))]))
    request = SimpleNamespace(fixturenames=["table_parser"], getfixturevalue=lambda name: parser)
    pytest_bdd_before_step_call(request, SimpleNamespace(filename="steps.feature"), None, step, None, {"datatable": rows})
    found = parser.validate(Numbered, rows).diagnostics
    return found.select("code", F.col("row").alias("line"), F.col("column").alias("place"), F.col("source_uri").alias("uri"))


@query("s11_objects", REGION)
def s11_objects(spark, sf):
    return spark.createDataFrame([(r.key, r.name) for r in api.parse_records(Regions, regions(spark, sf))], "key long, name string")


@query("f12_as_dict", REGION)
def f12_as_dict(spark, sf):
    return spark.createDataFrame([tuple(r.as_dict().values()) for r in Regions.parse_records(regions(spark, sf))], "key long, name string")


# Shape.


@query("h01_empty", values(("table_empty", "no rows"), ("header_empty", "no labels"), names="code, given"))
def h01_empty(spark, sf):
    given = {"no rows": [], "no labels": [[], ["x"]]}
    return spark.createDataFrame([(c, k) for k, t in given.items() for c in codes(Regions.validate(t))], "code string, given string")


@query("h05_ragged_columns", "SELECT 'ragged_row' AS code, 2 AS line, count(*)::BIGINT AS width FROM region")
def h05_ragged_columns(spark, sf):
    cells = transposed(region_rows(spark, sf))
    short = CellFrame(cells.df.filter("NOT (row_idx = 2 AND col_idx = 3)"))
    schema = made(ColumnTable, key=id_field("key"), name=field("name", required=True))
    found = schema.validate(short).diagnostics
    width = short.df.filter("row_idx = 2").agg(F.count("*").alias("width"))
    return found.select("code", F.col("row_idx" if "row_idx" in found.columns else "step_ordinal").alias("line")).join(width)


@query("h08_alias_clash", "SELECT 'duplicate_label' AS code, 'x' AS field_name, 2 AS place")
def h08_alias_clash(spark, sf):
    rows = [["title", "heading"], *([r[1], r[1]] for r in regions(spark, sf)[1:])]
    found = api.lenient(made(x=field("title", aliases=("heading",), required=True)), rows).diagnostics
    return found.select("code", "field_name", F.col("column").alias("place"))


@query("h09_no_records", values(("missing_required", "name", 1), names="code, field_name, n"))
def h09_no_records(spark, sf):
    return counts(api.lenient(Regions, [["key"]]))


class Renamed(RowTable):
    key = id_field("key", parser=P.integer())
    name = field("name", required=True)

    @classmethod
    def transform_table(cls, cells, context):
        return cells.map_values(lambda v: F.when((F.col("row_idx") == 1) & (v == "NAME"), "name").otherwise(v))


@query("h11_transform_hook", REGION)
def h11_transform_hook(spark, sf):
    rows = regions(spark, sf)
    return api.lenient(Renamed, [["key", "NAME"], *rows[1:]]).records.select("key", "name")


def listed(text: str) -> list[str]:
    """Keys with plus signs between them."""
    if "?" in text:
        raise TableError("unreadable", code="mine")
    return text.split("+")


class Doubled(ColumnTable):
    key = id_field("key")
    name = field("name", required=True)
    transformer = ColumnGroupExpander("key", listed, lambda text, n: [f"{text} {i}" for i in range(n)])


@query("h18_python_rules", "SELECT r_regionkey || x AS key, r_name || ' ' || i AS name FROM region, (VALUES ('a', 0), ('b', 1)) t(x, i)")
def h18_python_rules(spark, sf):
    rows = regions(spark, sf)[1:]
    return api.lenient(Doubled, [["key", *(f"{k}a+{k}b" for k, _ in rows)], ["name", *(n for _, n in rows)]]).records.select("key", "name")


# Fields, identity, references.

FIELD_RULES = {
    "label is text": lambda: field(3),
    "label is not empty": lambda: field(""),
    "id needs a label": lambda: id_field(None),
    "aliases are a collection": lambda: field("x", aliases="yz"),
    "aliases differ": lambda: field("x", aliases=("y", "y")),
    "required is true or false": lambda: field("x", required=1),
    "required has no default": lambda: field("x", required=True, default="a"),
    "default or factory": lambda: field("x", default="a", default_factory=lambda c: "b"),
    "default is immutable": lambda: field("x", default=[]),
    "factory is callable": lambda: field("x", default_factory="b"),
    "parser is callable": lambda: field("x", parser="int"),
    "policy is known": lambda: field("x", empty="drop"),
    "required refuses blanks": lambda: field("x", required=True, empty="none"),
    "separator is not empty": lambda: reference("x", many=True, separator=""),
    "variants are a mapping": lambda: discriminator("x", variants=[1]),
    "a plain field": lambda: field("x"),
}
FIELD_OUTCOMES = ["TypeError", "ValueError", "TypeError", "TypeError", "ValueError", "TypeError", "ValueError", "ValueError", "ValueError", "TypeError", "TypeError", "ValueError", "ValueError", "ValueError", "TypeError", "none"]


@query("f06_options", values(*zip(FIELD_RULES, FIELD_OUTCOMES), names="rule, outcome"))
def f06_options(spark, sf):
    return outcomes(spark, FIELD_RULES)


@query("j01_reference_record", "SELECT a.conv_id || '/' || a.turn AS key, b.conv_id || '/' || b.turn AS before_key FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1")
def j01_reference_record(spark, sf):
    from .queries import Turns, turn_cells

    return api.lenient(Turns, turn_cells(spark, sf), ordinal="n").with_referenced("before").select("key", F.col("before_record.key").alias("before_key"))


@query("j02_reference_records", "WITH m AS (SELECT max(p_partkey) AS m, min(p_partkey) AS l FROM part) SELECT p_partkey AS key, 2 AS n, 2 * p_partkey AS total FROM part, m WHERE p_partkey > l AND p_partkey < m")
def j02_reference_records(spark, sf):
    from .queries import Parts, part_cells

    got = api.lenient(Parts, part_cells(spark, sf), ordinal="n").with_referenced("near")
    keys = F.transform("near_record", lambda x: x["key"])
    return got.select("key", F.size("near_record").alias("n"), F.aggregate(keys, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total"))


@query("j02_reference_missing", "WITH m AS (SELECT max(p_partkey) AS m, min(p_partkey) AS l FROM part) SELECT 'reference_failed' AS code, 'near' AS field_name, count(*) AS n FROM part, m WHERE p_partkey = l OR p_partkey = m")
def j02_reference_missing(spark, sf):
    from .queries import Parts, part_cells

    return counts(api.lenient(Parts, part_cells(spark, sf), ordinal="n"))


@query("j05_blank_references", "SELECT c_custkey AS key FROM customer")
def j05_blank_references(spark, sf):
    schema = made(key=id_field("key", parser=P.integer()), near=reference("near", target="key"), many=reference("many", target="key", many=True))
    c = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.lit("").alias("near"), F.lit(None).cast("string").alias("many"), F.col("c_custkey").alias("n"))
    got = api.lenient(schema, c, ordinal="n").records
    return got.filter(F.col("near").isNull() & (F.size("many") == 0)).select("key")


class Order(Fields):
    total = field("total", required=True, parser=P.floating())


class Note(Fields):
    about = reference("about", target="key")


class Ledger(RowTable):
    key = id_field("key", parser=P.integer())
    kind = discriminator("kind", variants={"order": Order, "note": Note})


@query("j06_targets_across_variants", "SELECT -o_orderkey - 1 AS key, o_orderkey AS about FROM orders WHERE o_orderkey % 3 = 0")
def j06_targets_across_variants(spark, sf):
    o = read(spark, sf, "orders")
    order = o.select(F.col("o_orderkey").cast("string").alias("key"), F.lit("order").alias("kind"), F.col("o_totalprice").cast("string").alias("total"), F.lit("").alias("about"), (F.col("o_orderkey") * 2).alias("n"))
    note = o.filter("o_orderkey % 3 = 0").select((-F.col("o_orderkey") - 1).cast("string").alias("key"), F.lit("note").alias("kind"), F.lit("").alias("total"), F.col("o_orderkey").cast("string").alias("about"), (F.col("o_orderkey") * 2 + 1).alias("n"))
    return api.lenient(Ledger, order.unionByName(note), ordinal="n").records.filter("kind = 'note'").select("key", "about")


@query("v01_id_first", "SELECT 'parser_failed' AS code, 'key' AS field_name, count(*) AS n FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT 'parser_failed', 'nation', count(*) FROM supplier WHERE s_suppkey % 4 <> 0 AND s_suppkey % 3 = 0")
def v01_id_first(spark, sf):
    schema = made(nation=field("nation", required=True, parser=P.integer()), key=id_field("key", parser=P.integer()))
    s = read(spark, sf, "supplier")
    text = lambda c, k: F.when(F.col("s_suppkey") % k == 0, "?").otherwise(F.col(c).cast("string"))
    # A record whose id can't be read has no other diagnostic.
    return counts(api.lenient(schema, s.select(text("s_nationkey", 3).alias("nation"), text("s_suppkey", 4).alias("key"), F.col("s_suppkey").alias("n")), ordinal="n"))


@query("v02_first_kept", "SELECT n_regionkey::BIGINT AS key, arg_min(n_name, n_nationkey) AS name FROM nation GROUP BY 1")
def v02_first_kept(spark, sf):
    n = read(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("key"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("n"))
    return api.lenient(Regions, n, ordinal="n").records.select("key", "name")


@query("v03_plain_ids", "SELECT 'invalid_id' AS code, 'key' AS field_name, count(*) AS n FROM region")
def v03_plain_ids(spark, sf):
    schema = made(key=id_field("key", parser=P.split("+")), name=field("name"))
    return counts(api.lenient(schema, regions(spark, sf)))


@query("p12_each_python", "SELECT o_orderkey AS k, upper(o_orderpriority) || '!' AS x FROM orders")
def p12_each_python(spark, sf):
    shout = P.custom(lambda value, cell: value.upper() + "!" * (value != value.upper() or not value[0].isdigit()))
    got = keyed(read(spark, sf, "orders"), "o_orderkey", F.col("o_orderpriority"))
    found = api.lenient(one(P.compose(P.split("-", strip_items=False), P.each(shout))), got, ordinal="n").records
    return found.select("k", F.array_join("x", "-").alias("x"))


@query("p18_custom_batch", "SELECT s_suppkey AS k, length(s_name)::BIGINT AS x FROM supplier WHERE s_suppkey % 3 <> 0")
def p18_custom_batch(spark, sf):
    def sizes(texts: pd.Series) -> list:
        return [ValueError("third") if t.startswith("*") else len(t) for t in texts]

    text = F.concat(F.when(F.col("s_suppkey") % 3 == 0, "*").otherwise(""), F.col("s_name"))
    got = keyed(read(spark, sf, "supplier"), "s_suppkey", text)
    return api.lenient(one(P.custom(sizes, returns="bigint", batch=True)), got, ordinal="n").records.select("k", "x")


@query("p16_identity", "SELECT c_custkey AS k, c_name AS x FROM customer")
def p16_identity(spark, sf):
    return api.lenient(one(P.identity()), keyed(read(spark, sf, "customer"), "c_custkey", F.col("c_name")), ordinal="n").records.select("k", "x")


# Validation.


class Hooked(RowTable):
    key = field("key", required=True, parser=P.integer())
    balance = field("balance", required=True, parser=P.floating())

    def validate_record(self, context):
        if self.balance < context.get("least", 0):
            raise ValueError("in debt")


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    s = read(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_acctbal").cast("string").alias("balance"), F.col("s_nationkey").cast("string").alias("t"), F.col("s_suppkey").alias("n"))


@query("e01_record_hook", "SELECT 'record_validation_failed' AS code, s_suppkey AS ordinal FROM supplier WHERE s_acctbal < 100")
def e01_record_hook(spark, sf):
    found = api.lenient(Hooked, suppliers(spark, sf).drop("t"), ordinal="n", context={"least": 100}).diagnostics
    return found.select("code", F.col("record_ordinal").alias("ordinal"))


class Totalled(RowTable):
    key = field("key", required=True, parser=P.integer())
    balance = field("balance", required=True, parser=P.floating())

    @classmethod
    def validate_records(cls, records, context):
        if min(r.balance for r in records) < 0:
            raise TableError("a debtor", code="debtor")


@query("e02_table_hook", "SELECT s_nationkey::VARCHAR AS nation, 'debtor' AS code FROM supplier GROUP BY 1 HAVING min(s_acctbal) < 0")
def e02_table_hook(spark, sf):
    found = Totalled.validate(suppliers(spark, sf), table_id="t", ordinal="n").diagnostics
    return found.select(F.col("_table_id").alias("nation"), "code")


@query("e02_unique", "SELECT s_suppkey AS ordinal FROM supplier WHERE s_suppkey NOT IN (SELECT min(s_suppkey) FROM supplier GROUP BY s_nationkey)")
def e02_unique(spark, sf):
    schema = made(nation=field("t", required=True, parser=P.integer()), checks=(unique("nation"),))
    found = api.lenient(schema, suppliers(spark, sf).select("t", "n"), ordinal="n").diagnostics
    return found.select(F.col("record_ordinal").alias("ordinal"))


class Aggregated(RowTable):
    key = field("key", required=True, parser=P.integer())

    def validate_record(self, context):
        low = TableError("low", code="low")
        if self.key == 2:
            raise TableErrors([low, TableError("odd", code="odd", severity="warning")])
        if self.key == 3 and context.get("raise"):
            raise TableErrors([low, TableError("high", code="high")])


@query("e04_aggregates", values(("mixed", "low", "error"), ("mixed", "odd", "warning"), ("errors only", "low", "error"), ("errors only", "high", "error"), names="given, code, severity"))
def e04_aggregates(spark, sf):
    rows, out = [[r[0]] for r in regions(spark, sf)], []
    for given, context in (("mixed", {}), ("errors only", {"raise": True})):
        out += [(given, d.code, d.severity) for d in Aggregated.validate(rows, context=context).collect_diagnostics()]
    return spark.createDataFrame(out, "given string, code string, severity string")


@query("e07_validate_tables", "SELECT n_regionkey::VARCHAR AS region, count(*) AS records FROM nation GROUP BY 1 HAVING min(n_nationkey) > 0")
def e07_validate_tables(spark, sf):
    n = read(spark, sf, "nation").select(F.when(F.col("n_nationkey") == 0, "zero").otherwise(F.col("n_nationkey").cast("string")).alias("key"), F.col("n_regionkey").cast("string").alias("t"), F.col("n_nationkey").alias("n"))
    got = made(key=field("key", required=True, parser=P.integer())).validate(n, table_id="t", ordinal="n")
    # A table with an error gives out none of its records.
    return got.records.groupBy(F.col("_table_id").alias("region")).agg(F.count("*").alias("records"))


class Breaking(Sequence):
    def __len__(self):
        return 1

    def __getitem__(self, i):
        raise RuntimeError("broken")


@query("e08_internal_error", values(("internal_error", "internal_error"), names="validated, raised"))
def e08_internal_error(spark, sf):
    try:
        Regions.parse(Breaking())
    except TableError as e:
        raised = e.code
    return spark.createDataFrame([(codes(Regions.validate(Breaking()))[0], raised)], "validated string, raised string")


# Outputs.


@dataclasses.dataclass
class Place:
    key: int
    name: str

    def __post_init__(self):
        if self.name == "ASIA":
            raise ValueError("too large")


def rejected(call: Callable[[], Any]) -> list[Diagnostic]:
    try:
        call()
    except TableErrors as e:
        return list(e.diagnostics)
    except TableError as e:
        return [e.diagnostic]
    return []


def without_asia(spark, sf) -> list[list[str]]:
    return [r for r in regions(spark, sf) if r[1] != "ASIA"]


class Placed(RowTable):
    key = id_field("key", parser=P.integer())
    name = field("name", required=True)
    output_model = Place


class Built(RowTable):
    key = id_field("key", parser=P.integer())
    name = field("name", required=True)

    @classmethod
    def build_output(cls, record, context):
        return f"{record.key}{context['sep']}{record.name.lower()}"


@query("o01_output_model", "SELECT r_regionkey::BIGINT AS key, r_name AS name FROM region WHERE r_name <> 'ASIA'")
def o01_output_model(spark, sf):
    return spark.createDataFrame([(p.key, p.name) for p in Placed.parse_as(without_asia(spark, sf))], "key long, name string")


@query("o02_build_output", "SELECT r_regionkey || '=' || lower(r_name) AS text FROM region")
def o02_build_output(spark, sf):
    return spark.createDataFrame([(x,) for x in Built.parse_as(regions(spark, sf), context={"sep": "="})], "text string")


@query("o03_explicit_target", "SELECT r_regionkey::BIGINT AS key, r_name AS name FROM region")
def o03_explicit_target(spark, sf):
    # The target given takes the place of the schema's own model.
    return spark.createDataFrame([(x["key"], x["name"]) for x in Placed.parse_as(regions(spark, sf), dict)], "key long, name string")


@query("o04_output_failures", "SELECT 'output_failed' AS code, (r_regionkey + 2)::INTEGER AS line, r_regionkey::VARCHAR AS item FROM region WHERE r_name = 'ASIA'")
def o04_output_failures(spark, sf):
    found = rejected(lambda: Placed.parse_as(regions(spark, sf), error_mode="collect"))
    return spark.createDataFrame([(d.code, d.row, str(d.item_id)) for d in found], "code string, line int, item string")


@query("o05_models", values(("dataclass", "Place"), ("function", "str"), ("mapping", "dict"), names="target, made"))
def o05_models(spark, sf):
    rows = without_asia(spark, sf)[:2]
    targets = {"dataclass": Place, "mapping": dict, "function": lambda key, name: f"{key}{name}"}
    return spark.createDataFrame([(k, type(Placed.parse_as(rows, t)[0]).__name__) for k, t in targets.items()], "target string, made string")


# The schema compiler.


def reused() -> None:
    shared = field("x")
    made(a=shared)
    made(b=shared)


def two_bases() -> None:
    a = type(Fields)("A", (Fields,), {"x": field("x")})
    b = type(Fields)("B", (Fields,), {"x": field("y")})
    type(RowTable)("C", (RowTable, a, b), {})


def after_sealing() -> None:
    root = made(kind=discriminator_field("kind"), x=field("x"))
    root.variant("a")(type(RowTable)("Part", (root,), {"y": field("y")}))
    root.lenient([["kind", "x", "y"], ["a", "", ""]])
    root.variant("b")(type(RowTable)("Late", (root,), {"z": field("z")}))


def incompatible_targets() -> None:
    part = lambda name, parser: type(Fields)(name, (Fields,), {"code": field("code", required=True, parser=parser)})
    schema = made(kind=discriminator("kind", variants={"a": part("A", P.integer()), "b": part("B", P.string())}), near=reference("near", target="code"))
    schema.lenient([["kind", "code", "near"], ["a", "1", "1"]])


def frozen() -> None:
    Regions.name = 1


K_RULES: dict[str, dict[str, Callable[[], Any]]] = {
    "k01_collection": {"a field is declared once": reused, "bases agree": two_bases, "reserved names": lambda: made(parse=field("x")), "private names": lambda: made(_x=field("x")), "fields of bases": lambda: made(type(Fields)("Base", (RowTable,), {"x": field("x")}), y=field("y"))},
    "k02_annotations": {"text is resolved": lambda: made(x=field("x", required=True), annotations={"x": "int"}), "unknown names are left": lambda: made(x=field("x"), annotations={"x": "Nowhere"}), "a resolved one counts": lambda: made(x=field("x"), annotations={"x": "int"})},
    "k03_inference": {"union of two": lambda: made(x=field("x", required=True), annotations={"x": int | float}), "enum": lambda: made(x=field("x", required=True), annotations={"x": EventType}), "list needs a parser": lambda: made(x=field("x", required=True), annotations={"x": list[str]})},
    "k04_annotation_checks": {"missing is None": lambda: made(x=field("x", parser=P.integer(), empty="none"), annotations={"x": int}), "default fits": lambda: made(x=field("x", default="1", parser=P.integer(), empty="error"), annotations={"x": int}), "blank stays text": lambda: made(x=field("x", default=1, parser=P.integer()), annotations={"x": int}), "none is admitted": lambda: made(x=field("x", parser=P.integer(), empty="none"), annotations={"x": int | None})},
    "k05_collisions": {"labels differ": lambda: made(x=field("a"), y=field("a")), "aliases differ": lambda: made(x=field("a", aliases=("b",)), y=field("b")), "unknown_fields": lambda: made(x=field("x"), unknown_fields="drop"), "inapplicable_fields": lambda: made(x=field("x"), inapplicable_fields="drop"), "orientation": lambda: made(x=field("x"), orientation="diagonal")},
    "k06_one_id": {"one id at most": lambda: made(a=id_field("a"), b=id_field("b")), "columns need an id": lambda: made(ColumnTable, a=field("a")), "one discriminator": lambda: made(a=discriminator_field("a"), b=discriminator_field("b")), "rows need none": lambda: made(a=field("a"))},
    "k07_targets": {"undeclared target": lambda: made(a=field("a"), b=reference("b", target="c")), "declared target": lambda: made(a=field("a"), b=reference("b", target="a"))},
    "k08_hooks": {"validate_record": lambda: made(a=field("a"), validate_record=3), "validate_records": lambda: made(a=field("a"), validate_records=3), "build_output": lambda: made(a=field("a"), build_output=3), "output_model": lambda: made(a=field("a"), output_model=3), "transformer": lambda: made(a=field("a"), transformer=object())},
    "k09_freeze": {"a field": frozen, "a plan": lambda: setattr(Regions, "__plan__", None), "a hook": lambda: setattr(Regions, "validate_record", None), "anything else": lambda: setattr(made(a=field("a")), "note", 1)},
    "k10_sealing": {"late variant": after_sealing, "no variants": lambda: made(kind=discriminator_field("kind")).lenient([["kind"]]), "variant of no root": lambda: Regions.variant("x")(type(RowTable)("Sub", (Regions,), {}))},
    "k11_target_types": {"parsers differ": incompatible_targets},
}
K_OUTCOMES: dict[str, list[str]] = {
    "k01_collection": ["SchemaDefinitionError"] * 4 + ["none"],
    "k02_annotations": ["none", "none", "SchemaDefinitionError"],
    "k03_inference": ["SchemaDefinitionError", "none", "SchemaDefinitionError"],
    "k04_annotation_checks": ["SchemaDefinitionError"] * 3 + ["none"],
    "k05_collisions": ["SchemaDefinitionError"] * 5,
    "k06_one_id": ["SchemaDefinitionError"] * 3 + ["none"],
    "k07_targets": ["SchemaDefinitionError", "none"],
    "k08_hooks": ["SchemaDefinitionError"] * 5,
    "k09_freeze": ["AttributeError"] * 3 + ["none"],
    "k10_sealing": ["SchemaDefinitionError"] * 3,
    "k11_target_types": ["SchemaDefinitionError"],
}
for _name, _cases in K_RULES.items():
    query(_name, values(*zip(_cases, K_OUTCOMES[_name]), names="rule, outcome"))(lambda spark, sf, cases=_cases: outcomes(spark, cases))


# Functions, command line, pytest.


@query("a01_parse_table", REGION)
def a01_parse_table(spark, sf):
    return api.parse_table(Regions, regions(spark, sf)).select("key", "name")


@query("a02_parse_table_as", REGION)
def a02_parse_table_as(spark, sf):
    return spark.createDataFrame([tuple(x.values()) for x in api.parse_table_as(Regions, regions(spark, sf), dict)], "key long, name string")


@query("a03_validate_table", "SELECT 'parser_failed' AS code, count(*) AS n FROM region")
def a03_validate_table(spark, sf):
    got = api.validate_table(Numbered, regions(spark, sf))
    return got.diagnostics.groupBy("code").agg(F.count("*").alias("n"))


@query("a04_modes", values(("first", 1), ("collect", 5), names="mode, errors"))
def a04_modes(spark, sf):
    found = {m: rejected(lambda m=m: api.parse_table(Numbered, regions(spark, sf), error_mode=m)) for m in api.MODES}
    return spark.createDataFrame([(m, len(x)) for m, x in found.items()], "mode string, errors int")


@query("a05_warnings", values(("odd", 1), names="code, n"))
def a05_warnings(spark, sf):
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        Aggregated.lenient([["key"], ["2"]])
        made(a=field("a"), validate_record=lambda self, context: warn_of(self)).parse([["a"], ["x"], ["y"]])
    found = [w.message.diagnostic.code for w in seen if isinstance(w.message, TableWarning)]
    return spark.createDataFrame([(c, found.count(c)) for c in sorted(set(found))], "code string, n int")


def warn_of(record: Any) -> None:
    if record.a == "x":
        raise TableError("odd", code="odd", severity="warning")


@contextlib.contextmanager
def feature_file(spark: SparkSession, sf: str):
    """The regions' table in a feature file of the driver, which the command line reads there; the file goes afterwards."""
    lines = "\n".join(f"      | {k} | {n} |" for k, n in regions(spark, sf))
    with tempfile.TemporaryDirectory(prefix="gridsmith-") as folder:
        path = Path(folder) / "regions.feature"
        path.write_text(f"Feature: F\n  Scenario: S\n    Given the regions:\n{lines}\n", encoding="utf-8")
        yield path


def command(*args: Any) -> tuple[int, str]:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        code = cli.main([str(a) for a in args])
    return code, out.getvalue()


@query("a06_check_feature", "SELECT 'files' AS given, 'parser_failed' AS code, (4 + r_regionkey + 1)::INTEGER AS line FROM region UNION ALL SELECT 'tables', 'parser_failed', (4 + r_regionkey + 1)::INTEGER FROM region")
def a06_check_feature(spark, sf):
    with feature_file(spark, sf) as path:
        _, found = check_files(path, schema=Numbered)
        tables = check_feature_tables(discover_feature_tables(path), schema=Numbered)
    rows = [("files", x.diagnostic.code, x.diagnostic.row) for x in found]
    return spark.createDataFrame(rows + [("tables", x.diagnostic.code, x.diagnostic.row) for x in tables], "given string, code string, line int")


@query("a07_exit_codes", values(("valid", 0, "valid"), ("errors", 1, "failed"), ("no match", 2, "no_matches"), ("no schema", 1, "failed"), ("describe", 0, "none"), names="given, exit_code, status"))
def a07_exit_codes(spark, sf):
    me = __name__
    with feature_file(spark, sf) as path:
        runs = {
            "valid": command("check", path, "--schema", f"{me}:Regions", "--format", "json"),
            "errors": command("check", path, "--schema", f"{me}:Numbered", "--format", "json"),
            "no match": command("check", path, "--schema", f"{me}:Regions", "--step", "others:", "--format", "json"),
            "no schema": command("check", path, "--schema", f"{me}:Nothing", "--format", "json"),
            "describe": command("describe", f"{me}:Regions", "--format", "json"),
        }
    return spark.createDataFrame([(k, code, json.loads(text).get("status", "none")) for k, (code, text) in runs.items()], "given string, exit_code int, status string")


@query("a08_cli_text", "SELECT 'Found ' || count(*) || ' table error(s) and 0 warning(s) in 1 table(s)' AS last FROM region")
def a08_cli_text(spark, sf):
    with feature_file(spark, sf) as path:
        _, text = command("check", path, "--schema", f"{__name__}:Numbered", "--step", "the regions:", "--scenario", "S")
    return spark.createDataFrame([(text.strip().split("\n")[-1],)], "last string")


@query("a09_cli_json", "SELECT 'name' AS field, 'Numbered' AS schema, r_name AS value, 'F' AS feature, 'S' AS scenario, 'the regions:' AS step FROM region")
def a09_cli_json(spark, sf):
    with feature_file(spark, sf) as path:
        _, text = command("check", path, "--schema", f"{__name__}:Numbered", "--format", "json")
    names = ("field", "schema", "value", "feature", "scenario", "step")
    return spark.createDataFrame([tuple(d[n] for n in names) for d in json.loads(text)["diagnostics"]], ", ".join(f"{n} string" for n in names))


@query("a10_cli_describe", values(("key", "bigint"), ("name", "string"), names="name, type"))
def a10_cli_describe(spark, sf):
    _, text = command("describe", f"{__name__}:Regions", "--format", "json")
    return spark.createDataFrame([(f["name"], f["type"]) for f in json.loads(text)["fields"]], "name string, type string")


@query("a11_import_references", values(("module", "none"), ("nested", "none"), ("no colon", "ValueError"), ("no module", "ModuleNotFoundError"), ("no attribute", "AttributeError"), ("no file", "FileNotFoundError"), ("not a schema", "TypeError"), ("not a context", "TypeError"), names="rule, outcome"))
def a11_import_references(spark, sf):
    me = __name__
    return outcomes(
        spark,
        {
            "module": lambda: cli.schema_of(f"{me}:Regions"),
            "nested": lambda: cli.import_object(f"{me}:Regions.parse"),
            "no colon": lambda: cli.import_object(me),
            "no module": lambda: cli.import_object("gridsmith_nowhere:x"),
            "no attribute": lambda: cli.import_object(f"{me}:nowhere"),
            "no file": lambda: cli.import_object("/nowhere/x.py:y"),
            "not a schema": lambda: cli.schema_of(f"{me}:values"),
            "not a context": lambda: cli.context_of(f"{me}:Place.__doc__.upper"),
        },
    )


@query("a12_pytest_facade", values(("parse", 5), ("parse_as", 5), ("validate", 0), names="call, n"))
def a12_pytest_facade(spark, sf):
    rows, parser = regions(spark, sf), TableParser()
    found = [("parse", len(parser.parse(Regions, rows))), ("parse_as", len(parser.parse_as(Regions, rows, dict))), ("validate", len(parser.validate(Regions, rows).errors))]
    return spark.createDataFrame(found, "call string, n int")


# Names that the package gives out.
EXPORTS = ["AlphabeticRange", "CellContext", "CellDSLChain", "DefaultContext", "DiagnosticSeverity", "FeatureDiagnostic", "FeatureTable", "Field", "FieldContract", "NumericRange", "PrefixRepeat", "RangeRule", "RecordSource", "ReferenceSpec", "RepeatRule", "SuffixRepeat", "TableContract", "TableData", "TableErrorCode", "TableFields", "TableTransformer", "ValidationResult", "VariantContract", "check_feature", "discover_feature_tables", "CellDSL", "CellFrame", "ColumnGroupExpander", "ColumnTable", "Diagnostic", "ParseContext", "RowTable", "SchemaDefinitionError", "TableCell", "TableError", "TableErrors", "TableWarning", "TransformerPipeline", "boolean", "choice", "compose", "compose_cell_dsls", "compose_transformers", "date", "datetime", "decimal", "discriminator", "discriminator_field", "each", "enum", "field", "floating", "id_field", "identity", "integer", "literal", "map_value", "optional", "parse_table", "parse_table_as", "read_tables", "reference", "split", "string", "validate_table"]


@query("a13_exports", values(*((n,) for n in EXPORTS), names="name"))
def a13_exports(spark, sf):
    import gridsmith

    return spark.createDataFrame([(n,) for n in EXPORTS if n in gridsmith.__all__ and hasattr(gridsmith, n)], "name string")


class Tagged(Enum):
    ROW = "row"


@query("a14_plain_data", values(("mapping", "{\"entries\":[[1,\"a\"]],\"type\":\"mapping\"}"), ("nan", "{\"type\":\"float\",\"value\":\"nan\"}"), ("cell", "\"v\""), ("member", "row"), names="given, data"))
def a14_plain_data(spark, sf):
    from .diagnostics import compact, stable_json

    shown = {"mapping": {1: "a"}, "nan": float("nan"), "cell": TableCell("v", 1, 1).value}
    rows = [(k, compact(stable_json(v))) for k, v in shown.items()] + [("member", stable_json(Tagged.ROW)["value"])]
    return spark.createDataFrame(rows, "given string, data string")


