"""Parsers against Python's own reading of the same text."""

import datetime as dt
import math
from enum import Enum

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsmith.functions import parsers as P


def run(spark, parser, texts):
    """(value, error) of each text."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = P.to_parser(parser).apply(F.col("t"), T.StringType(), None)
    return [(r["v"], r["e"]) for r in df.select("i", got.value.alias("v"), got.error.alias("e")).orderBy("i").collect()]


def reads(f, text):
    try:
        return f(text), True
    except ValueError:
        return None, False


INTS = ["1", "+7", "-0", " 42 ", "\t5\n", "1_000", "1__0", "_1", "1_", "", " ", "1.5", "1e3", "0x10", "007", "9223372036854775807", "abc", "--1", "1 2", "\x1c3", "１"]


def test_integer_reads_like_int(spark):
    for text, (value, error) in zip(INTS, run(spark, P.integer(), INTS)):
        want, ok = reads(int, text)
        if not text.isascii():
            ok = False  # only ASCII digits are read
        assert (error is None) == ok, (text, value, error)
        assert value == (want if ok else None)


@pytest.mark.parametrize("base", [2, 8, 16, 36, 0])
def test_integer_bases(spark, base):
    texts = ["0", "101", "0b101", "0o17", "0x1F", "fg", "zz", "-7f", "+0X_ff", "08", "0_0", "12", "1_2", "7fffffffffffffff", "8000000000000000", "-8000000000000000"]
    for text, (value, error) in zip(texts, run(spark, P.integer(base=base), texts)):
        want, ok = reads(lambda t: int(t, base), text)
        ok = ok and -(2**63) <= want < 2**63
        assert (value, error is None) == (want if ok else None, ok), (base, text, value, error)


FLOATS = ["1", "1.5", ".5", "5.", "1e3", "1E-3", "nan", "-inf", "Infinity", "1.5f", "1d", "1_0.5", "1__0", "e3", ".", "", " 2 ", "+.5e+1", "0x1p3"]


def test_floating_reads_like_float(spark):
    for text, (value, error) in zip(FLOATS, run(spark, P.floating(), FLOATS)):
        want, ok = reads(float, text)
        assert (error is None) == ok, text
        assert not ok or value == want or (math.isnan(value) and math.isnan(want))


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet="0123456789+-_. eE\tnaif", max_size=9), min_size=1, max_size=40))
def test_numbers_differential(spark, texts):
    for text, (value, error), (number, wrong) in zip(texts, run(spark, P.integer(), texts), run(spark, P.floating(), texts)):
        want, ok = reads(int, text)
        assert (value, error is None) == (want if ok else None, ok), text
        want, ok = reads(float, text)
        assert (wrong is None) == ok, text
        assert not ok or number == want or (number != number and want != want)


def test_decimal_is_exact(spark):
    texts = ["12.30", "12.345", "1e2", "1.5e-1", "1e-3", "NaN", "", " 7 ", "100", "99999999999", "0.120", "1_0"]
    got = run(spark, P.decimal(6, 2), texts)
    assert [str(v) if v is not None else None for v, _ in got] == ["12.30", None, "100.00", "0.15", None, None, None, "7.00", "100.00", None, "0.12", "10.00"]
    assert all((v is None) == (e is not None) for v, e in got)


FORMATS = {
    "%Y-%m-%d": ["2026-07-18", "2026-7-8", "226-7-8", "2025-02-29", "2024-02-29", " 2026-07-18", "2026-07-18 ", "2026", "2026-13-01", ""],
    "%d/%m/%y": ["01/02/68", "1/2/69", "31/04/24", "01/02/2024"],
    "%d %b %Y": ["3 JUL 2026", "03  jul 2026", "3 July 2026", "31 Feb 2024"],
    "%B %d, %Y": ["March 5, 2024", "march 05, 2024", "Mar 5, 2024"],
    "%Y %j": ["2024 366", "2023 366", "2023 001", "2023 1"],
}


@pytest.mark.parametrize("form", FORMATS)
def test_dates_read_like_strptime(spark, form):
    for text, (value, error) in zip(FORMATS[form], run(spark, P.date(format=form), FORMATS[form])):
        want, ok = reads(lambda t: dt.datetime.strptime(t, form).date(), text)
        assert (value, error is None) == (want, ok), (form, text, value, error)


TIMES = {
    "%Y-%m-%dT%H:%M:%S": ["2026-07-18T09:08:07", "2026-7-8T9:8:7", "2026-07-18T24:00:00", "2026-07-18T09:08:60", "2026-07-18 09:08:07"],
    "%Y-%m-%d %H:%M:%S.%f": ["2026-07-18 09:08:07.5", "2026-07-18 09:08:07.123456", "2026-07-18  09:08:07.1"],
    "%Y-%m-%d %I:%M %p": ["2026-07-18 12:05 AM", "2026-07-18 12:05 pm", "2026-07-18 1:05 PM", "2026-07-18 13:05 PM"],
}


@pytest.mark.parametrize("form", TIMES)
def test_datetimes_read_like_strptime(spark, form):
    for text, (value, error) in zip(TIMES[form], run(spark, P.datetime(format=form), TIMES[form])):
        want, ok = reads(lambda t: dt.datetime.strptime(t, form), text)
        assert (value, error is None) == (want, ok), (form, text, value, error)


def test_offsets_become_instants(spark):
    texts = ["2026-07-18T09:00:00+0530", "2026-07-18T09:00:00+05:30", "2026-07-18T09:00:00Z", "2026-07-18T09:00:00-01:00", "2026-07-18T09:00:00"]
    form = "%Y-%m-%dT%H:%M:%S%z"
    got = P.datetime(format=form).apply(F.col("t"), T.StringType(), None)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", F.unix_micros(got.value).alias("v"), got.error.alias("e")).orderBy("i").collect()
    for text, r in zip(texts, rows):
        want, ok = reads(lambda t: dt.datetime.strptime(t, form).timestamp(), text)
        assert (r["e"] is None) == ok
        assert not ok or r["v"] == round(want * 1e6)


def test_temporal_formats_are_checked():
    with pytest.raises(ValueError):
        P.date(format="")
    with pytest.raises(TypeError):
        P.datetime(format=3)


def test_boolean_vocabulary(spark):
    assert run(spark, P.boolean(), ["true", "FALSE", "yes", "1", " true"])[0:2] == [(True, None), (False, None)]
    assert [v for v, _ in run(spark, P.boolean(), ["yes", "1", " true", ""])] == [None] * 4
    strict = P.boolean(true_values=("Y",), false_values=("N",), case_sensitive=True)
    assert [v for v, _ in run(spark, strict, ["Y", "N", "y"])] == [True, False, None]
    for bad in ({"true_values": ("x",), "false_values": ("X",)}, {"true_values": ()}):
        with pytest.raises(ValueError):
            P.boolean(**bad)
    with pytest.raises(TypeError):
        P.boolean(true_values="true")


def test_choice_map_split_compose(spark):
    assert run(spark, P.choice("Draft", "Done", case_sensitive=False), ["draft", "DONE", "x"]) == [("Draft", None), ("Done", None), (None, "Expected one of ['Draft', 'Done']")]
    assert run(spark, P.map_value({"a": 1, "b": None}), ["a", "b", "c"]) == [(1, None), (None, None), (None, "No mapped value for 'c'")]
    assert [v for v, _ in run(spark, P.split("."), ["a. b..", "", "a"])] == [["a", "b"], [], ["a"]]
    assert [v for v, _ in run(spark, P.split(",", strip_items=False, keep_empty=True), ["a, b,", ""])] == [["a", " b", ""], [""]]
    ages = P.compose(P.split(","), P.each(P.integer()))
    assert run(spark, ages, ["1, 2", "1,x,y", ""]) == [([1, 2], None), (None, "invalid literal for int() with base 10: 'x'"), ([], None)]
    assert run(spark, P.compose(P.integer(), P.choice("1", "2")), ["01", "3", "x"])[0] == ("1", None)
    assert run(spark, P.each(P.integer()), ["1"])[0][1] is not None
    with pytest.raises(ValueError):
        P.compose()


def test_optional_enum_literal(spark):
    assert run(spark, P.optional(P.integer()), ["", "None", "NULL", "5", "x"]) == [(None, None)] * 3 + [(5, None), (None, "invalid literal for int() with base 10: 'x'")]

    class Status(Enum):
        DRAFT = "draft"
        DONE = "done"

    parser = P.enum(Status)
    assert [v for v, _ in run(spark, parser, ["draft", "DONE", "Draft"])] == ["DRAFT", "DONE", None]
    assert parser.decode("DONE") is Status.DONE
    assert [v for v, _ in run(spark, P.literal("a", "b"), ["a", "A", " b"])] == ["a", None, None]


def test_string_steps_and_quotes(spark):
    assert [v for v, _ in run(spark, P.string(strip=True, upper=True), ["\xa0 a\t", "\x1fb"])] == ["A", "B"]
    with pytest.raises(ValueError):
        P.string(lower=True, upper=True)
    for text in ["it's", 'say "x"', "both ' and \"", "back\\slash", "line\nfeed"]:
        assert run(spark, P.integer(), [text])[0][1].endswith(repr(text))
