"""Queries against the SQL that says the same, and what their plans hold."""

import duckdb
import pytest

import gridsmith as G
from gridsmith import acceptance

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()
# Those that are quick; the driver runs all of them.
QUICK = [n for n in acceptance.SQL if n[0] == "k" and n[1:3].isdigit()] + [
    "s03_ensure", "s04_feature_scan", "s05_scenarios", "s06_outline", "s07_coordinates", "s08_provenance", "f14_filters", "f06_options",
    "j02_reference_records", "v02_first_kept", "p12_each", "p12_each_python", "p18_custom_batch", "e02_unique", "e02_table_hook", "e07_validate_tables",
    "p04_decimal", "p05_date_custom", "p06_datetime_micros", "p06_datetime_offset", "a10_cli_describe", "a11_import_references", "a13_exports", "a14_plain_data",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_agrees_with_sql(spark, con, name):
    got = acceptance.QUERIES[name](spark, SMALL)
    want = con.execute(acceptance.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    same = lambda v: "~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted([same(r[n]) for n in names] for r in got.collect()) == sorted([same(v) for v in r] for r in want.fetchall())


def test_every_query_of_an_operator_has_sql():
    assert set(acceptance.QUERIES) == set(acceptance.SQL)


class Sheet(G.RowTable):
    whole: int = G.field("whole", required=True)
    ratio: float = G.field("ratio", required=True)
    price = G.field("price", required=True, parser=G.decimal(12, 2))
    day = G.field("day", required=True, parser=G.date())
    at = G.field("at", required=True, parser=G.datetime(format="%Y-%m-%dT%H:%M:%S%z"))
    parts = G.field("parts", required=True, parser=G.compose(G.split(";"), G.each(G.integer())))


def patterns(df) -> int:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("RLIKE") + plan.count("regexp_")


def test_cells_are_taken_apart_once(spark):
    df = spark.createDataFrame([("1", "1.5", "2.50", "2024-01-31", "2024-01-31T01:02:03+02:00", "1;2")], "whole string, ratio string, price string, day string, at string, parts string")
    got = Sheet.lenient(df)
    for name in ("whole", "ratio", "price", "day", "at"):
        # Once for the value of all records, and once more where a filter for good ones goes ahead of it.
        assert patterns(got.all_records.select(name)) == 1, name
    assert patterns(got.records) <= 2 * 6 + 2 and patterns(got.diagnostics) <= 6 + 2
    assert got.records.select("whole", "parts").first() == (1, [1, 2]) and got.diagnostics.isEmpty()
