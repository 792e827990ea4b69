"""One query for each operator over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum
from typing import Literal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .diagnostics import ERROR
from .fields import discriminator, discriminator_field, field, id_field, reference
from .functions import parsers as P
from .functions.cell_dsl import CellDSL
from .operators.checks import aggregate, all_rows, at_least, check, unique
from .operators.groups import AlphabeticRange, ColumnGroupExpander, PrefixRepeat, SuffixRepeat
from .operators.transforms import TransformerPipeline
from .schema import ColumnTable, Fields, RowTable
from .sources.cells import CELL_SCHEMA, CellFrame

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def records(schema: type, df: DataFrame, *columns: str, **options) -> DataFrame:
    return api.lenient(schema, df, **options).records.select(*columns)


def counts(result: api.Result) -> DataFrame:
    return result.diagnostics.groupBy("code", "field_name").agg(F.count("*").alias("n"))


def text_orders(spark: SparkSession, sf: str) -> DataFrame:
    """orders as text cells."""
    o = read(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("key"),
        F.format_string("%.2f", "o_totalprice").alias("total"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("placed"),
        F.lower("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderkey").alias("n"),
    )


class Orders(RowTable):
    key = id_field("key", parser=P.integer())
    total = field("total", required=True, parser=P.decimal(12, 2))
    placed = field("placed", required=True, parser=P.date())
    status = field("status", required=True, parser=P.choice("F", "O", "P", case_sensitive=False))
    priority = field("priority", required=True, parser=P.compose(P.split("-"), P.each(P.string(strip=True))))


@query("flagship_orders", "SELECT o_orderkey AS key, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS total, strftime(o_orderdate, '%Y-%m-%d') AS placed, o_orderstatus AS status, list_extract(string_split(o_orderpriority, '-'), 2) AS priority FROM orders")
def flagship_orders(spark, sf):
    got = records(Orders, text_orders(spark, sf), "key", "total", "placed", "status", "priority", ordinal="n")
    return got.withColumns({"priority": F.get("priority", F.lit(1)), "total": F.col("total").cast("string"), "placed": F.col("placed").cast("string")})


def one(parser, label: str = "x", **options) -> type:
    """A schema of an ordinal and one parsed field."""
    return type(RowTable)("One", (RowTable,), {"k": field("k", required=True, parser=P.integer()), "x": field(label, parser=parser, **options), "__module__": __name__})


def parsed(parser, df: DataFrame, **options) -> DataFrame:
    return records(one(parser, **options), df, "k", "x", ordinal="n")


def keyed(df: DataFrame, key: str, text) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("k"), text.alias("x"), F.col(key).alias("n"))


@query("p01_string", "SELECT c_custkey AS k, lower(c_name) AS x FROM customer")
def p01_string(spark, sf):
    return parsed(P.string(strip=True, lower=True), keyed(read(spark, sf, "customer"), "c_custkey", F.concat(F.lit(" \t"), "c_name", F.lit(" "))))


@query("p02_integer", "SELECT o_orderkey AS k, o_custkey AS x FROM orders")
def p02_integer(spark, sf):
    return parsed(P.integer(), keyed(read(spark, sf, "orders"), "o_orderkey", F.concat(F.lit(" +"), F.col("o_custkey").cast("string"))))


@query("p02_integer_hex", "SELECT o_orderkey AS k, o_custkey AS x FROM orders")
def p02_integer_hex(spark, sf):
    return parsed(P.integer(base=16), keyed(read(spark, sf, "orders"), "o_orderkey", F.concat(F.lit("0x"), F.lower(F.hex("o_custkey")))))


@query("p03_floating", "SELECT o_orderkey AS k, o_totalprice AS x FROM orders")
def p03_floating(spark, sf):
    return parsed(P.floating(), keyed(read(spark, sf, "orders"), "o_orderkey", F.col("o_totalprice").cast("string")))


@query("p04_decimal", "SELECT o_orderkey AS k, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS x FROM orders")
def p04_decimal(spark, sf):
    return parsed(P.decimal(12, 2), keyed(read(spark, sf, "orders"), "o_orderkey", F.format_string("%.2f", "o_totalprice"))).withColumn("x", F.col("x").cast("string"))


@query("p05_date", "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS x FROM orders")
def p05_date(spark, sf):
    return parsed(P.date(), keyed(read(spark, sf, "orders"), "o_orderkey", F.date_format("o_orderdate", "y-M-d"))).withColumn("x", F.col("x").cast("string"))


@query("p05_date_custom", "SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS x FROM orders")
def p05_date_custom(spark, sf):
    return parsed(P.date(format="%d %b %Y"), keyed(read(spark, sf, "orders"), "o_orderkey", F.upper(F.date_format("o_orderdate", "dd  MMM yyyy")))).withColumn("x", F.col("x").cast("string"))


@query("p06_datetime", "SELECT o_orderkey AS k, date_trunc('second', o_orderdate) AS x FROM orders")
def p06_datetime(spark, sf):
    return parsed(P.datetime(), keyed(read(spark, sf, "orders"), "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")))


@query("p06_datetime_micros", "SELECT event_id AS k, ts AS x FROM events")
def p06_datetime_micros(spark, sf):
    return parsed(P.datetime(format="%Y/%m/%d %H:%M:%S.%f"), keyed(read(spark, sf, "events"), "event_id", F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSSSSS")))


@query("p06_datetime_offset", "SELECT event_id AS k, date_trunc('second', ts) - INTERVAL 5 HOUR - INTERVAL 30 MINUTE AS x FROM events")
def p06_datetime_offset(spark, sf):
    got = parsed(P.datetime(format="%Y-%m-%dT%H:%M:%S%z"), keyed(read(spark, sf, "events"), "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+05:30'")))
    # An instant, shown as the local time in UTC.
    return got.select("k", F.timestamp_add("MICROSECOND", F.unix_micros("x"), F.lit("1970-01-01").cast("timestamp_ntz")).alias("x"))


@query("p07_boolean", "SELECT doc_id AS k, quality = 1 AS x FROM labels")
def p07_boolean(spark, sf):
    return parsed(P.boolean(true_values=("good",), false_values=("bad",)), keyed(read(spark, sf, "labels"), "doc_id", F.when(F.col("quality") == 1, "GOOD").otherwise("bad")))


@query("p08_choice", "SELECT c_custkey AS k, c_mktsegment AS x FROM customer")
def p08_choice(spark, sf):
    segments = P.choice("FURNITURE", "MACHINERY", "BUILDING", "AUTOMOBILE", "HOUSEHOLD", case_sensitive=False)
    return parsed(segments, keyed(read(spark, sf, "customer"), "c_custkey", F.lower("c_mktsegment")))


@query("p09_split", "SELECT o_orderkey AS k, len(string_split(o_orderpriority, '-'))::INTEGER AS x FROM orders")
def p09_split(spark, sf):
    return parsed(P.split("."), keyed(read(spark, sf, "orders"), "o_orderkey", F.concat(F.translate("o_orderpriority", "-", "."), F.lit(". .")))).withColumn("x", F.size("x"))


@query("p10_map_value", "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END::BIGINT AS x FROM orders")
def p10_map_value(spark, sf):
    return parsed(P.map_value({"f": 1, "o": 2, "P": 3}, case_sensitive=False), keyed(read(spark, sf, "orders"), "o_orderkey", F.col("o_orderstatus")))


@query("p11_compose", "SELECT p_partkey AS k, CAST(substr(p_brand, 7) AS BIGINT) AS x FROM part")
def p11_compose(spark, sf):
    brand = P.compose(P.string(lower=True), P.split("#"), P.each(P.optional(P.integer(), none_values=("brand",))))
    return parsed(brand, keyed(read(spark, sf, "part"), "p_partkey", F.col("p_brand"))).withColumn("x", F.get("x", F.lit(1)))


@query("p12_each", "SELECT l_orderkey AS k, l_linenumber AS line, l_partkey + l_suppkey AS x FROM lineitem")
def p12_each(spark, sf):
    li = read(spark, sf, "lineitem")
    df = li.select(F.col("l_orderkey").cast("string").alias("k"), F.concat_ws(" ; ", "l_partkey", "l_suppkey").alias("x"), F.col("l_linenumber").cast("string").alias("line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"))
    schema = type(RowTable)("Lines", (RowTable,), {"k": field("k", required=True, parser=P.integer()), "line": field("line", required=True, parser=P.integer()), "x": field("x", required=True, parser=P.compose(P.split(";"), P.each(P.integer()))), "__module__": __name__})
    return records(schema, df, "k", F.col("line").cast("int").alias("line"), F.aggregate("x", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("x"), ordinal="n")


@query("p13_optional", "SELECT c_custkey AS k, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS x FROM customer")
def p13_optional(spark, sf):
    return parsed(P.optional(P.string()), keyed(read(spark, sf, "customer"), "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "None").otherwise(F.col("c_mktsegment"))))


class EventType(Enum):
    VIEW = "view"
    SIGNUP = "signup"
    ERROR = "error"
    CLICK = "click"
    PURCHASE = "purchase"


class TypedEvents(RowTable):
    k: int = field("k", required=True)
    x: EventType = field("x", required=True)


@query("p14_enum", "SELECT event_id AS k, upper(event_type) AS x FROM events")
def p14_enum(spark, sf):
    return records(TypedEvents, keyed(read(spark, sf, "events"), "event_id", F.col("event_type")), "k", "x", ordinal="n")


class English(RowTable):
    k: int = field("k", required=True)
    x: Literal["en", "de"] = field("x", required=True)


@query("p15_literal", "SELECT doc_id AS k, lang AS x FROM documents WHERE lang IN ('en', 'de')")
def p15_literal(spark, sf):
    return records(English, keyed(read(spark, sf, "documents"), "doc_id", F.col("lang")), "k", "x", ordinal="n")


class Inferred(RowTable):
    k: int = field("k", required=True)
    price: float = field("price", required=True)
    status: str | None = field("status", empty="parse")


@query("p17_inference", "SELECT o_orderkey AS k, o_totalprice AS price, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS status FROM orders")
def p17_inference(spark, sf):
    df = read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_totalprice").cast("string").alias("price"), F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderkey").alias("n"))
    return records(Inferred, df, "k", "price", "status", ordinal="n")


@query("p18_custom_parser", "SELECT s_suppkey AS k, reverse(s_name) AS x FROM supplier")
def p18_custom_parser(spark, sf):
    return parsed(P.custom(lambda value, cell: value[::-1], returns="string"), keyed(read(spark, sf, "supplier"), "s_suppkey", F.col("s_name")))


@query("f07_default_missing", "SELECT n_nationkey::BIGINT AS k, 'unknown' AS x FROM nation")
def f07_default_missing(spark, sf):
    return parsed(None, keyed(read(spark, sf, "nation"), "n_nationkey", F.col("n_name")).drop("x"), default="unknown")


def blanked(spark, sf):
    return keyed(read(spark, sf, "customer"), "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")))


@query("f08_empty_raw", "SELECT c_custkey AS k, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS x FROM customer")
def f08_empty_raw(spark, sf):
    return parsed(None, blanked(spark, sf))


@query("f08_empty_none", "SELECT c_custkey AS k, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS x FROM customer")
def f08_empty_none(spark, sf):
    return parsed(None, blanked(spark, sf), empty="none")


@query("f08_empty_parse", "SELECT c_custkey AS k, CASE WHEN c_mktsegment <> 'BUILDING' THEN lower(c_mktsegment) END AS x FROM customer")
def f08_empty_parse(spark, sf):
    return parsed(P.optional(P.string(lower=True)), blanked(spark, sf), empty="parse")


@query("f08_empty_error", "SELECT 'empty_optional' AS code, 'x' AS field_name, count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING' HAVING count(*) > 0")
def f08_empty_error(spark, sf):
    return counts(api.lenient(one(None, empty="error"), blanked(spark, sf), ordinal="n"))


def made_up(cell):
    return F.concat(F.lit("generated-"), F.col("_ordinal").cast("string"))


made_up.native = True


@query("f10_default_factory", "SELECT s_suppkey AS k, 'generated-' || s_suppkey AS x FROM supplier")
def f10_default_factory(spark, sf):
    return parsed(None, keyed(read(spark, sf, "supplier"), "s_suppkey", F.col("s_name")).drop("x"), default_factory=made_up)


@query("f10_default_factory_python", "SELECT s_suppkey AS k, 'row ' || s_suppkey AS x FROM supplier")
def f10_default_factory_python(spark, sf):
    return parsed(None, keyed(read(spark, sf, "supplier"), "s_suppkey", F.col("s_name")).drop("x"), default_factory=lambda context: f"row {context.row}")


@query("f11_record_filter", "SELECT o_orderkey AS k, o_custkey AS x FROM orders WHERE o_custkey % 7 <> 0")
def f11_record_filter(spark, sf):
    dirty = F.when(F.col("o_custkey") % 7 == 0, F.lit("1.5")).otherwise(F.col("o_custkey").cast("string"))
    return parsed(P.integer(), keyed(read(spark, sf, "orders"), "o_orderkey", dirty))


@query("f13_source_for", "SELECT o_orderkey AS k, upper(o_orderstatus) AS source_value, 2 AS source_column FROM orders")
def f13_source_for(spark, sf):
    got = api.lenient(one(P.string(lower=True)), keyed(read(spark, sf, "orders"), "o_orderkey", F.col("o_orderstatus")), ordinal="n").records
    cell = F.col("_source.cells")["x"]
    return got.select("k", cell["source_value"].alias("source_value"), cell["source_column"].alias("source_column"))


def region_rows(spark, sf) -> CellFrame:
    r = read(spark, sf, "region").select((F.col("r_regionkey") + 1).alias("n"), F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("name"))
    return CellFrame.from_wide(r, ordinal="n")


class Regions(RowTable):
    key = id_field("key", parser=P.integer())
    name = field("name", required=True)


class RegionColumns(ColumnTable):
    key = id_field("key", parser=P.integer())
    name = field("name", required=True)


REGION = "SELECT r_regionkey::BIGINT AS key, r_name AS name FROM region"


@query("h02_row", REGION)
def h02_row(spark, sf):
    return api.lenient(Regions, region_rows(spark, sf)).records.select("key", "name")


def transposed(cells: CellFrame) -> CellFrame:
    names = [f.name for f in CELL_SCHEMA]
    return CellFrame(cells.df.withColumns({"row_idx": F.col("col_idx"), "col_idx": F.col("row_idx")}).select(*names), cells.empty, cells.uri)


@query("h03_column", REGION)
def h03_column(spark, sf):
    return api.lenient(RegionColumns, transposed(region_rows(spark, sf))).records.select("key", "name")


@query("h04_ragged_row", "SELECT 'ragged_row' AS code, CAST(NULL AS VARCHAR) AS field_name, count(*) AS n FROM nation WHERE n_nationkey % 5 = 0")
def h04_ragged_row(spark, sf):
    n = read(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("n"), F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name"))
    cells = CellFrame.from_wide(n, ordinal="n")
    short = cells.df.filter((F.col("row_idx") == 1) | (F.col("col_idx") == 1) | ((F.col("row_idx") - 2) % 5 != 0))
    return counts(api.lenient(Regions, CellFrame(short)))


@query("h06_duplicate_label", "SELECT 'duplicate_label' AS code, CAST(NULL AS VARCHAR) AS field_name, 1::BIGINT AS n UNION ALL SELECT 'unknown_field', NULL, 1")
def h06_duplicate_label(spark, sf):
    df = read(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_name").alias("name"), F.lit("x").alias("name"), F.lit("y").alias("other"), F.col("r_regionkey").alias("n"))
    return counts(api.lenient(Regions, df, ordinal="n"))


@query("h09_missing_required", "SELECT 'missing_required' AS code, 'name' AS field_name, count(*) AS n FROM region")
def h09_missing_required(spark, sf):
    df = read(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("key"), F.col("r_regionkey").alias("n"))
    return counts(api.lenient(Regions, df, ordinal="n"))


@query("h10_alias", "SELECT n_nationkey::BIGINT AS k, n_name AS x FROM nation")
def h10_alias(spark, sf):
    return parsed(None, keyed(read(spark, sf, "nation"), "n_nationkey", F.col("n_name")).withColumnRenamed("x", "full name"), aliases=("full name", "title"))


class Upper:
    def transform(self, cells, context, *, schema=None):
        return cells.map_values(lambda v: F.when(F.col("row_idx") > 1, F.concat(v, F.lit("!"))).otherwise(v))


class Marked(RowTable):
    key = id_field("key", parser=P.compose(P.string(), P.split("!"), P.custom(lambda v, c: int(v[0]), returns="bigint")))
    name = field("name", required=True)
    transformer = TransformerPipeline(Upper(), Upper())


@query("h12_transformers", "SELECT r_name || '!!' AS name, r_name AS written FROM region")
def h12_transformers(spark, sf):
    got = api.lenient(Marked, region_rows(spark, sf)).records
    return got.select("name", F.col("_source.cells")["name"]["source_value"].alias("written"))


class Grouped(ColumnTable):
    key = id_field("key", parser=P.integer())
    kind = field("kind", required=True)
    size = field("size", required=True)
    transformer = ColumnGroupExpander("key", repeat_rule=PrefixRepeat())


def grouped_cells(spark, sf, keys, kind, size) -> CellFrame:
    """One column for each region, which stands for a range of keys."""
    r = read(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("k"), "r_name")
    row = lambda i, value: r.select(F.lit("").alias("table_id"), F.lit(i).alias("row_idx"), (F.col("k") + 2).alias("col_idx"), value.alias("value"))
    heads = spark.createDataFrame([("", i, 1, x) for i, x in enumerate(("key", "kind", "size"), 1)], "table_id string, row_idx int, col_idx int, value string")
    cells = heads.unionByName(row(1, keys)).unionByName(row(2, kind)).unionByName(row(3, size))
    return CellFrame.from_cells(cells.select("*", F.col("row_idx").alias("source_row"), F.col("col_idx").alias("source_column"), F.col("value").alias("source_value"), F.lit(None).cast("string").alias("source_uri")))


@query("h13_group_expand", "SELECT (r_regionkey * 10 + i)::BIGINT AS key, r_name AS kind, 'all' AS size, '3:' || r_name AS written FROM region, range(1, 4) t(i)")
def h13_group_expand(spark, sf):
    cells = grouped_cells(spark, sf, F.concat((F.col("k") * 10 + 1).cast("string"), F.lit(".."), (F.col("k") * 10 + 3).cast("string")), F.concat(F.lit("3:"), "r_name"), F.lit("all"))
    return api.lenient(Grouped, cells).records.select("key", "kind", "size", F.col("_source.cells")["kind"]["source_value"].alias("written"))


class Lettered(ColumnTable):
    key = id_field("key")
    kind = field("kind", required=True)
    size = field("size", required=True)
    transformer = ColumnGroupExpander("key", AlphabeticRange(), SuffixRepeat())


@query("h15_letters", "SELECT chr((97 + r_regionkey * 3 + i)::INTEGER) AS key, r_name AS kind, 'all' AS size FROM region, range(0, 3) t(i)")
def h15_letters(spark, sf):
    letter = lambda i: F.char(F.lit(97) + F.col("k") * 3 + i)
    cells = grouped_cells(spark, sf, F.concat(letter(0), F.lit("-"), letter(2)), F.concat("r_name", F.lit(" x3")), F.lit("all"))
    return api.lenient(Lettered, cells).records.select("key", "kind", "size")


class Lines(RowTable):
    order = id_field("order", parser=P.integer())


@query("v02_duplicate_id", "SELECT 'duplicate_id' AS code, 'order' AS field_name, count(*) - count(DISTINCT l_orderkey) AS n FROM lineitem")
def v02_duplicate_id(spark, sf):
    df = read(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("order"), (F.col("l_orderkey") * 100_000_000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("n"))
    df = df.groupBy("order", "n").agg(F.count("*").alias("c")).withColumn("c", F.explode(F.sequence(F.lit(1), F.col("c").cast("int")))).select("order", (F.col("n") * 64 + F.col("c")).alias("n"))
    return counts(api.lenient(Lines, df, ordinal="n"))


class Purchase(Fields):
    amount = field("amount", required=True, parser=P.floating())


class Failure(Fields):
    detail = field("detail", required=True)


class Plain(Fields):
    pass


class Events(RowTable):
    key = id_field("key", parser=P.integer())
    kind = discriminator("kind", variants={"purchase": Purchase, "error": Failure, "view": Plain, "signup": Plain, "click": Plain})


def event_cells(spark, sf, everywhere: bool = False) -> DataFrame:
    e = read(spark, sf, "events")
    amount = F.when(F.lit(everywhere) | (F.col("event_type") == "purchase"), F.col("value").cast("string")).otherwise("")
    return e.select(F.col("event_id").cast("string").alias("key"), F.col("event_type").alias("kind"), amount.alias("amount"), F.when(F.col("event_type") == "error", F.col("props")).otherwise("").alias("detail"), F.col("event_id").alias("n"))


@query("v04_variant_select", "SELECT event_id AS key, event_type AS kind, event_type AS variant, CASE WHEN event_type = 'purchase' THEN value END AS amount, CASE WHEN event_type = 'error' THEN props END AS detail FROM events")
def v04_variant_select(spark, sf):
    return records(Events, event_cells(spark, sf), "key", "kind", F.col("_variant").alias("variant"), "amount", "detail", ordinal="n")


@query("v04_unknown_variant", "SELECT 'unknown_variant' AS code, 'kind' AS field_name, count(*) AS n FROM events WHERE event_type = 'click'")
def v04_unknown_variant(spark, sf):
    df = event_cells(spark, sf).withColumn("kind", F.when(F.col("kind") == "click", "tap").otherwise(F.col("kind")))
    return counts(api.lenient(Events, df, ordinal="n"))


@query("v05_inapplicable", "SELECT 'inapplicable_field' AS code, CAST(NULL AS VARCHAR) AS field_name, count(*) AS n FROM events WHERE event_type <> 'purchase'")
def v05_inapplicable(spark, sf):
    return counts(api.lenient(Events, event_cells(spark, sf, True), ordinal="n"))


class Preserving(RowTable):
    inapplicable_fields = "preserve"
    key = id_field("key", parser=P.integer())
    kind = discriminator("kind", variants={"purchase": Purchase, "error": Failure, "view": Plain, "signup": Plain, "click": Plain})


@query("v05_preserve", "SELECT event_id AS key, CASE WHEN event_type <> 'purchase' THEN value END AS kept FROM events")
def v05_preserve(spark, sf):
    return records(Preserving, event_cells(spark, sf, True), "key", F.col("_extras")["amount"].cast("double").alias("kept"), ordinal="n")


class Registered(RowTable):
    key = id_field("key", parser=P.integer())
    kind = discriminator_field("kind")


@Registered.variant("purchase")
class Bought(Registered):
    amount = field("amount", required=True, parser=P.floating())


@Registered.variant("error")
class Broke(Registered):
    detail = field("detail", required=True)


@query("v08_variant_frame", "SELECT event_id AS key, event_type AS kind, value AS amount FROM events WHERE event_type = 'purchase'")
def v08_variant_frame(spark, sf):
    return Registered.variant_frame(api.lenient(Registered, event_cells(spark, sf), ordinal="n").records, "purchase")


class Turns(RowTable):
    key = id_field("key")
    before = reference("before", target="key")


def turn_cells(spark, sf) -> DataFrame:
    c = read(spark, sf, "conversations")
    key = F.concat_ws("/", F.col("conv_id"), F.col("turn"))
    return c.select(key.alias("key"), F.concat_ws("/", F.col("conv_id"), F.col("turn") - 1).alias("before"), (F.col("conv_id") * 1000 + F.col("turn")).alias("n"))


@query("j01_reference", "SELECT a.conv_id || '/' || a.turn AS key, b.conv_id || '/' || b.turn AS before FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1")
def j01_reference(spark, sf):
    return records(Turns, turn_cells(spark, sf), "key", "before", ordinal="n")


@query("j01_reference_missing", "SELECT 'reference_failed' AS code, 'before' AS field_name, count(*) AS n FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1 WHERE b.turn IS NULL")
def j01_reference_missing(spark, sf):
    return counts(api.lenient(Turns, turn_cells(spark, sf), ordinal="n"))


class Parts(RowTable):
    key = id_field("key", parser=P.integer())
    near = reference("near", target="key", many=True)


PARTS = "WITH m AS (SELECT max(p_partkey) AS m, min(p_partkey) AS l FROM part) "


def part_cells(spark, sf) -> DataFrame:
    p = read(spark, sf, "part")
    return p.select(F.col("p_partkey").cast("string").alias("key"), F.concat_ws(", ", F.col("p_partkey") - 1, F.col("p_partkey") + 1).alias("near"), F.col("p_partkey").alias("n"))


@query("j02_reference_many", PARTS + "SELECT p_partkey AS key, (p_partkey - 1) || ' ' || (p_partkey + 1) AS near FROM part, m WHERE p_partkey > l AND p_partkey < m")
def j02_reference_many(spark, sf):
    return records(Parts, part_cells(spark, sf), "key", F.array_join(F.transform("near", lambda x: x.cast("string")), " ").alias("near"), ordinal="n")


class Brands(RowTable):
    key = id_field("key", parser=P.integer())
    brand = field("brand", required=True)
    like = reference("like", target="brand")


@query("j04_target_unique", "SELECT 'reference_failed' AS code, 'brand' AS field_name, count(*) AS n FROM (SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) > 1)")
def j04_target_unique(spark, sf):
    p = read(spark, sf, "part")
    return counts(api.lenient(Brands, p.select(F.col("p_partkey").cast("string").alias("key"), F.col("p_brand").alias("brand"), F.col("p_brand").alias("like"), F.col("p_partkey").alias("n")), ordinal="n"))


class CheckedLines(RowTable):
    key = field("key", required=True, parser=P.integer())
    discount = field("discount", required=True, parser=P.floating())
    tax = field("tax", required=True, parser=P.floating())
    checks = (check("discount <= tax", "A discount exceeds the tax", at="discount"), check("tax > 0", "No tax", severity="warning", at="tax"))


def line_cells(spark, sf) -> DataFrame:
    li = read(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").cast("string").alias("key"), F.col("l_discount").cast("string").alias("discount"), F.col("l_tax").cast("string").alias("tax"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"))


@query("e01_record_check", "SELECT 'record_validation_failed' AS code, 'discount' AS field_name, 'error' AS severity, count(*) AS n FROM lineitem WHERE l_discount > l_tax UNION ALL SELECT 'record_validation_failed', 'tax', 'warning', count(*) FROM lineitem WHERE l_tax <= 0")
def e01_record_check(spark, sf):
    return api.lenient(CheckedLines, line_cells(spark, sf), ordinal="n").diagnostics.groupBy("code", "field_name", "severity").agg(F.count("*").alias("n"))


@query("e03_warning", "SELECT l_orderkey AS key, l_discount AS discount, l_tax AS tax FROM lineitem WHERE l_discount <= l_tax")
def e03_warning(spark, sf):
    return records(CheckedLines, line_cells(spark, sf), "key", "discount", "tax", ordinal="n")


class Suppliers(RowTable):
    key = id_field("key", parser=P.integer())
    nation = field("nation", required=True, parser=P.integer())
    balance = field("balance", required=True, parser=P.floating())
    checks = (
        unique("nation", code="nation_repeated"),
        at_least(1, "balance < -100000", code="no_debtor"),
        all_rows("balance > 0", code="debtor"),
        aggregate("count(*)", "value > 0", code="none"),
    )


@query("e02_table_checks", "SELECT 'nation_repeated' AS code, count(*) - count(DISTINCT s_nationkey) AS n FROM supplier HAVING count(*) > count(DISTINCT s_nationkey) UNION ALL SELECT 'no_debtor', 1 UNION ALL SELECT 'debtor', 1 FROM supplier HAVING count(*) FILTER (WHERE s_acctbal <= 0) > 0")
def e02_table_checks(spark, sf):
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_nationkey").cast("string").alias("nation"), F.col("s_acctbal").cast("string").alias("balance"), F.col("s_suppkey").alias("n"))
    return api.lenient(Suppliers, s, ordinal="n").diagnostics.groupBy("code").agg(F.count("*").alias("n"))


DIRTY = "SELECT 'empty_required' AS code, 'total' AS field_name, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'parser_failed', 'placed', count(*) FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT 'parser_failed', 'status', count(*) FROM orders WHERE o_orderkey % 7 = 0"


def dirty_orders(spark, sf) -> DataFrame:
    o = text_orders(spark, sf)
    return o.withColumns({"total": F.when(F.col("n") % 3 == 0, "").otherwise(F.col("total")), "placed": F.when(F.col("n") % 5 == 0, "2025-02-30").otherwise(F.col("placed")), "status": F.when(F.col("n") % 7 == 0, "x").otherwise(F.col("status"))})


@query("e05_collect_counts", DIRTY)
def e05_collect_counts(spark, sf):
    return counts(api.lenient(Orders, dirty_orders(spark, sf), ordinal="n"))


@query("e05_first_error", "SELECT code, field_name, ordinal FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'empty_required' ELSE 'parser_failed' END AS code, CASE WHEN o_orderkey % 3 = 0 THEN 'total' WHEN o_orderkey % 5 = 0 THEN 'placed' ELSE 'status' END AS field_name, o_orderkey AS ordinal FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 ORDER BY o_orderkey LIMIT 1)")
def e05_first_error(spark, sf):
    found = api.lenient(Orders, dirty_orders(spark, sf), ordinal="n").ordered().filter(F.col("severity") == ERROR).limit(1)
    return found.select("code", "field_name", F.col("record_ordinal").alias("ordinal"))


@query("e06_barrier", "SELECT 'parser_failed' AS code, count(*) AS n FROM lineitem WHERE l_orderkey % 11 = 0")
def e06_barrier(spark, sf):
    df = line_cells(spark, sf).withColumn("tax", F.when(F.col("key").cast("bigint") % 11 == 0, "x").otherwise(F.col("tax")))
    # Conversion failed somewhere, so no check is reported.
    return api.barrier(api.lenient(CheckedLines, df, ordinal="n").diagnostics).filter(F.col("severity") == ERROR).groupBy("code").agg(F.count("*").alias("n"))


@query("e07_rejected", "SELECT count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 7 = 0")
def e07_rejected(spark, sf):
    return api.lenient(Orders, dirty_orders(spark, sf), ordinal="n").rejected.agg(F.count("*").alias("n"))


@query("c01_token", "SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN 'now' WHEN o_orderpriority = '5-LOW' THEN 'later' ELSE o_orderpriority END AS x FROM orders")
def c01_token(spark, sf):
    dsl = CellDSL().token("1-URGENT", fields="x", to="now").token("5-LOW", to="later")
    return parsed(dsl, keyed(read(spark, sf, "orders"), "o_orderkey", F.col("o_orderpriority")))


@query("c02_pattern", "SELECT doc_id AS k, CAST(substr(source, 4) AS BIGINT) AS x FROM documents")
def c02_pattern(spark, sf):
    dsl = CellDSL(returns="bigint").pattern(r"src(?P<number>\d+)", to=lambda group: group("number"))
    return parsed(dsl, keyed(read(spark, sf, "documents"), "doc_id", F.col("source")))


@query("c03_when", "SELECT page_id AS k, CASE WHEN url LIKE 'https:%' THEN 'secure' ELSE 'plain' END AS x FROM pages")
def c03_when(spark, sf):
    dsl = CellDSL().when(lambda cell: cell.startswith("https:"), to="secure").fallback(to="plain")
    return parsed(dsl, keyed(read(spark, sf, "pages"), "page_id", F.col("url")))


@query("c06_chain", "SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN 'now' ELSE lower(substr(o_orderpriority, 3)) END AS x FROM orders")
def c06_chain(spark, sf):
    first, second = CellDSL().token("1-URGENT", to="now"), CellDSL().pattern(r"(\d)-(?P<name>.+)", to=lambda group: F.lower(group("name")))
    return parsed(first | second, keyed(read(spark, sf, "orders"), "o_orderkey", F.col("o_orderpriority")))


def python_dsl() -> CellDSL:
    dsl = CellDSL(returns="bigint")

    @dsl.pattern(r"src(?P<number>\d+)")
    def number(match, context):
        return int(match["number"]) * 2

    return dsl


@query("c02_pattern_python", "SELECT doc_id AS k, CAST(substr(source, 4) AS BIGINT) * 2 AS x FROM documents")
def c02_pattern_python(spark, sf):
    return parsed(python_dsl(), keyed(read(spark, sf, "documents"), "doc_id", F.col("source")))


@query("s12_summary", "SELECT count(*) FILTER (WHERE o_orderkey % 3 = 0) + count(*) FILTER (WHERE o_orderkey % 5 = 0) + count(*) FILTER (WHERE o_orderkey % 7 = 0) AS error_count, 0::BIGINT AS warning_count FROM orders")
def s12_summary(spark, sf):
    got = api.lenient(Orders, dirty_orders(spark, sf), ordinal="n").diagnostics
    return got.agg(F.count_if(F.col("severity") == ERROR).alias("error_count"), F.count_if(F.col("severity") != ERROR).alias("warning_count"))


@query("s13_to_rows", "SELECT r_regionkey + 2 AS row_idx, r_regionkey || '|' || r_name AS cells FROM region UNION ALL SELECT 1, 'key|name'")
def s13_to_rows(spark, sf):
    return region_rows(spark, sf).row_arrays().select("row_idx", F.array_join("cells", "|").alias("cells"))


@query("k12_describe", "SELECT * FROM (VALUES ('key', 'bigint', TRUE), ('total', 'decimal(12,2)', FALSE), ('placed', 'date', FALSE), ('status', 'string', FALSE), ('priority', 'array<string>', FALSE)) t(name, type, is_id)")
def k12_describe(spark, sf):
    return Orders.describe().to_frame(spark).select("name", "type", "is_id")
