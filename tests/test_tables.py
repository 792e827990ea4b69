"""Rows, columns, fields, variants, references, checks and transforms on small literal tables."""

import dataclasses
import datetime as dt
import warnings
from decimal import Decimal
from enum import Enum
from typing import Literal

import pytest
from pyspark.sql import functions as F

import gridsmith as G
from gridsmith.diagnostics import Diagnostic

pytestmark = pytest.mark.usefixtures("spark")


def found(result):
    return [(d.code, d.row, d.column) for d in result.collect_diagnostics()]


class Buoys(G.RowTable):
    """Readings of drifting buoys."""

    station = G.field("station", required=True)
    depth: int = G.field("depth m", required=True)
    sensors = G.field("sensors", parser=G.split(";"))
    online = G.field("online", parser=G.boolean(true_values=("up",), false_values=("down",)), default=True)


def test_rows_become_typed_records():
    sheet = [["station", "depth m", "sensors", "online"], ["N-7", "+120", "salt; wind;", "DOWN"], ["N-9", "-4", "", "up"], ["S-1", "0", "wave", ""]]
    got = Buoys.parse_records(sheet)
    assert [b.as_dict() for b in got] == [
        {"station": "N-7", "depth": 120, "sensors": ["salt", "wind"], "online": False},
        {"station": "N-9", "depth": -4, "sensors": None, "online": True},
        {"station": "S-1", "depth": 0, "sensors": ["wave"], "online": None},
    ]
    # A default stands in for a missing label, not for a blank cell.
    assert Buoys.lenient([["depth m", "station"], ["3", "S-2"]]).records.first()["online"] is True


def test_diagnostics_come_in_order_of_discovery():
    sheet = [["depth m", "station", "online"], ["9", "E-1", "maybe"], ["deep", "", "up"], ["1.5", "E-2", ""]]
    got = Buoys.validate(sheet)
    # Within a record the fields' own order counts, not that of the columns.
    assert found(got) == [("parser_failed", 2, 3), ("empty_required", 3, 2), ("parser_failed", 3, 1), ("parser_failed", 4, 1)]
    assert not got.valid and got.records.isEmpty() and got.rejected.count() == 3
    with pytest.raises(G.TableError) as first:
        Buoys.parse(sheet)
    assert (first.value.code, first.value.row, first.value.column, first.value.field) == ("parser_failed", 2, 3, "online")
    with pytest.raises(G.TableErrors) as every:
        Buoys.parse(sheet, error_mode="collect")
    assert [e.row for e in every.value] == [2, 3, 3, 4] and str(every.value).startswith("Table contains 4 errors:\n1. ")
    with pytest.raises(ValueError):
        Buoys.parse(sheet, error_mode="some")


def test_lenient_keeps_what_is_good():
    got = Buoys.lenient([["station", "depth m"], ["W-1", "ten"], ["W-2", "10"], ["", "11"]])
    assert [tuple(r) for r in got.records.select("station", "depth").collect()] == [("W-2", 10)]
    assert got.rejected.count() == 2 and got.counts == (2, 0)


@pytest.mark.parametrize("table,codes", [
    ([], ["table_empty"]),
    ([[]], ["header_empty"]),
    ("station", ["invalid_table_input"]),
    ([["station", "depth m"], ["A", 7]], ["invalid_table_input"]),
    ([["station", "depth m"], ["A", "7", "8"], ["B", "7"]], ["ragged_row"]),
    ([["station", "depth m", "station"], ["A", "7", "B"]], ["duplicate_label"]),
    ([["colour"]], ["unknown_field", "missing_required", "missing_required"]),
    ([["station"], ["A"], ["B"]], ["missing_required", "missing_required"]),
])
def test_shapes(table, codes):
    assert [d.code for d in Buoys.validate(table).collect_diagnostics()] == codes


def test_ids_are_read_first_and_kept_once():
    class Tides(G.RowTable):
        height: float = G.field("height", required=True)
        hour = G.id_field("hour", parser=G.integer(base=0))

    sheet = [["height", "hour"], ["0.5", "0x10"], ["low", "noon"], ["1.25", "16"], ["high", "17"], ["2", "0b10000"]]
    got = Tides.validate(sheet)
    assert found(got) == [("parser_failed", 3, 2), ("duplicate_id", 4, 2), ("parser_failed", 5, 1), ("duplicate_id", 6, 2)]
    assert [d.item_id for d in got.collect_diagnostics()] == ["noon", 16, 17, 16]

    class Sets(G.RowTable):
        tags = G.id_field("tags", parser=G.split("+"))

    assert [d.code for d in Sets.validate([["tags"], ["x+y"], ["z"]]).collect_diagnostics()] == ["invalid_id", "invalid_id"]


class Channels(G.ColumnTable):
    """Channels between ports, a column each."""

    port: int = G.id_field("Port no.")
    name = G.field("Name", required=True)
    upstream = G.reference("Upstream", target="port")
    links = G.reference("Links", target="port", many=True, separator="/")


def test_columns_refer_to_each_other():
    sheet = [["Port no.", "40", "41", "42", "43"], ["Links", "41 / 42", "", "43/43/40", "42"], ["Name", "Oak", "Elm", "Ash", "Yew"], ["Upstream", "43", "", "40", "43"]]
    got = Channels.parse_records(sheet)
    assert [(c.port, c.upstream, c.links) for c in got] == [(40, 43, [41, 42]), (41, None, []), (42, 40, [43, 43, 40]), (43, 43, [42])]
    assert [c.name for c in got] == ["Oak", "Elm", "Ash", "Yew"]


def test_references_that_fail():
    sheet = [["Port no.", "5", "6", "7"], ["Name", "a", "b", "c"], ["Upstream", "8", "5", "five"], ["Links", "", "5/9", "7//5/zz"]]
    # Single references are looked up before lists, each for all records.
    assert sorted(found(Channels.validate(sheet))) == sorted([("reference_failed", 3, 2), ("reference_failed", 3, 4), ("reference_failed", 4, 3), ("reference_failed", 4, 4), ("reference_failed", 4, 4)])

    class Berths(G.ColumnTable):
        number = G.id_field("No.")
        quay = G.field("Quay")
        beside = G.reference("Beside", target="quay")

    # An ambiguous target is one diagnostic, at its second place, and hides lookups of it.
    sheet = [["No.", "1", "2", "3", "4"], ["Beside", "north", "none", "", "west"], ["Quay", "west", "north", "west", "west"]]
    assert found(Berths.validate(sheet)) == [("reference_failed", 3, 4)]


def test_shapes_of_columns():
    assert [d.code for d in Channels.validate([["Name", "x"], ["Port no.", "1"]]).collect_diagnostics()] == ["invalid_id"]
    assert found(Channels.validate([["Port no.", "1", "2"], ["Name", "x", "y", "z"], ["Upstream"], ["Links", "", ""]])) == [("ragged_row", 2, None), ("ragged_row", 3, None)]
    assert found(Channels.validate([["Port no.", "8", "9", "+8"], ["Name", "x", "", "z"]])) == [("empty_required", 2, 3), ("duplicate_id", 1, 4)]


def test_aliases():
    class Aliased(G.RowTable):
        name = G.field("name", aliases=("full name",), required=True)

    assert Aliased.parse_records([["full name"], ["x"]])[0].name == "x"
    assert [c for c, *_ in found(Aliased.validate([["name", "full name"], ["a", "b"]]))] == ["duplicate_label"]
    with pytest.raises(G.SchemaDefinitionError):

        class Clash(G.RowTable):
            a = G.field("x", aliases=("y",))
            b = G.field("y")


@pytest.mark.parametrize("policy,want", [("raw", ""), ("none", None), ("parse", None), ("error", "empty_optional")])
def test_empty_policies(policy, want):
    schema = type(G.RowTable)("T", (G.RowTable,), {"k": G.field("k"), "v": G.field("v", parser=G.optional(G.string()) if policy == "parse" else None, empty=policy), "__module__": __name__})
    got = schema.lenient([["k", "v"], ["a", ""]])
    if policy == "error":
        assert found(got) == [(want, 2, 2)]
    else:
        assert got.records.first()["v"] == want


class Hull(Enum):
    STEEL = "st"
    WOOD = "wd"


class Vessels(G.RowTable):
    hull: Hull = G.field("hull", required=True)
    launched: dt.date = G.field("launched", required=True)
    tonnage: Decimal = G.field("tonnage", required=True)
    crew: int = G.field("crew", required=True)
    speed: float = G.field("speed", required=True)
    leased: bool = G.field("leased", required=True)
    seen: dt.datetime | None = G.field("seen", empty="parse")
    flag: Literal["NO", "SE"] = G.field("flag", required=True)


def test_parsers_are_inferred_from_annotations():
    sheet = [["crew", "flag", "hull", "launched", "leased", "seen", "speed", "tonnage"], ["1_200", "SE", "WOOD", "1999-2-28", "False", "None", "1e1", "77.70"], ["0", "NO", "st", "2024-02-29", "true", "2024-03-01T06:07:08", "-.5", "1e2"]]
    a, b = Vessels.parse_records(sheet)
    assert (a.crew, a.flag, a.hull, a.launched, a.leased, a.seen, a.speed, a.tonnage) == (1200, "SE", Hull.WOOD, dt.date(1999, 2, 28), False, None, 10.0, Decimal("77.70"))
    assert (b.crew, b.hull, b.launched, b.leased, b.seen, b.speed, b.tonnage) == (0, Hull.STEEL, dt.date(2024, 2, 29), True, dt.datetime(2024, 3, 1, 6, 7, 8), -0.5, 100)


@pytest.mark.parametrize("build", [
    lambda: {"x": G.field("x", empty="parse")},
    lambda: {"x": G.field("a"), "y": G.field("a")},
    lambda: {"parse": G.field("a")},
    lambda: {"x": G.reference("x", target="nope")},
    lambda: {"a": G.id_field("a"), "b": G.id_field("b")},
    lambda: {"x": G.field("x"), "unknown_fields": "ignore"},
    lambda: {"x": G.field("x"), "inapplicable_fields": "ignore"},
    lambda: {"x": G.field("x"), "__annotations__": {"x": int}},
    lambda: {"x": G.field("x", default="1", parser=G.integer()), "__annotations__": {"x": int}},
    lambda: {"x": G.field("x"), "transformer": object()},
])
def test_schemas_that_cannot_be_compiled(build):
    with pytest.raises(G.SchemaDefinitionError):
        type(G.RowTable)("Bad", (G.RowTable,), build() | {"__module__": __name__})


@pytest.mark.parametrize("build", [lambda: G.field(""), lambda: G.field("x", required=True, default=1), lambda: G.field("x", default=[]), lambda: G.field("x", empty="drop"), lambda: G.field("x", required=True, empty="raw"), lambda: G.field("x", default=1, default_factory=list), lambda: G.reference("x", separator=""), lambda: G.discriminator("x", variants={})])
def test_field_options(build):
    with pytest.raises(ValueError):
        build()


def test_declared_schemas_are_fixed():
    with pytest.raises(AttributeError):
        Buoys.station = 1
    shared = G.field("x")

    class One(G.RowTable):
        x = shared

    with pytest.raises(G.SchemaDefinitionError):

        class Two(G.RowTable):
            x = shared

    class Base(G.Fields):
        a = G.field("a")

    class Left(Base):
        pass

    class Right(Base):
        pass

    class Both(G.RowTable, Left, Right):
        b = G.field("b")

    assert list(Both.__fields__) == ["a", "b"]


class Sail(G.Fields):
    area = G.field("Sail m2", required=True, parser=G.floating())


class Motor(G.Fields):
    fuels = G.field("Fuels", required=True, parser=G.split("|"))


class Fleet(G.ColumnTable):
    hull_no = G.id_field("Hull")
    drive = G.discriminator("Drive", variants={"sail": Sail, "motor": Motor})
    home = G.field("Home port")


FLEET = [["Hull", "h1", "h2", "h3"], ["Fuels", "", "oil|gas", ""], ["Home port", "Oslo", "", "Bergen"], ["Sail m2", "33.5", "", "8"], ["Drive", "sail", "motor", "sail"]]


def test_variants():
    rows = Fleet.parse_records(FLEET)
    assert [type(r).__name__ for r in rows] == ["Fleet[sail]", "Fleet[motor]", "Fleet[sail]"]
    assert (rows[0].area, rows[1].fuels, rows[2].home) == (33.5, ["oil", "gas"], "Bergen")
    assert Fleet.variant_for("motor") is type(rows[1])
    frame = Fleet.variant_frame(Fleet.lenient(FLEET).records, "motor")
    assert set(frame.columns) == {"fuels", "hull_no", "drive", "home"} and frame.count() == 1
    wrong = [["Hull", "h1", "h2", "h3"], ["Drive", "steam", "sail", "motor"], ["Sail m2", "5", "", "6"], ["Fuels", "", "", "oil"]]
    assert found(Fleet.validate(wrong)) == [("unknown_variant", 2, 2), ("empty_required", 3, 3), ("inapplicable_field", 3, 4)]


def test_explicit_variants_seal():
    class Base(G.RowTable):
        kind = G.discriminator_field("kind")

    @Base.variant("card")
    class Card(Base):
        digits = G.field("digits", required=True)

    with pytest.raises(ValueError):
        Base.variant("card")(type("Again", (Base,), {}))
    with pytest.raises(TypeError):
        Base.variant("x")(int)
    assert Base.parse_records([["kind", "digits"], ["card", "1234"]])[0].digits == "1234"
    with pytest.raises(G.SchemaDefinitionError):
        Base.variant("late")(type("Late", (Base,), {}))


def test_preserved_cells():
    class Keeping(G.RowTable):
        inapplicable_fields = "preserve"
        kind = G.discriminator("kind", variants={"a": Sail, "p": Motor})

    r = Keeping.parse_records([["kind", "Sail m2", "Fuels"], ["a", "12", "tar | peat"]])[0]
    assert dict(r.table_extras) == {"Fuels": "tar | peat"} and r.area == 12


def test_default_factories():
    class Made(G.RowTable):
        key = G.id_field("key")
        name = G.field("name", default_factory=lambda c: f"{c.item_id}-{c.user_data['suffix']}")

    assert Made.parse_records([["key"], ["a"]], context={"suffix": "z"})[0].name == "a-z"
    assert [c for c, *_ in found(Made.validate([["key"], ["a"]]))] == ["default_factory_failed"]


def test_custom_parsers():
    def read(value, cell):
        if value == "bad":
            raise ValueError(f"no {cell.row}/{cell.column}")
        if value == "odd":
            raise G.TableError("odd one", code="mine")
        return len(value) + cell.user_data.get("more", 0)

    class Own(G.RowTable):
        x = G.field("x", parser=G.custom(read, returns="bigint"))

    assert Own.parse_records([["x"], ["abc"]], context={"more": 10})[0].x == 13
    got = Own.validate([["x"], ["bad"], ["odd"]]).collect_diagnostics()
    assert [(d.code, d.message) for d in got] == [("parser_failed", "Cannot read 'x': no 2/1"), ("mine", "Cannot read 'x': odd one")]


def test_record_and_table_checks():
    class Scores(G.RowTable):
        key = G.id_field("key")
        score: int = G.field("score", required=True)
        checks = (G.check("score >= 0", "negative", at="score"), G.check("score < 100", "high", severity="warning"), G.unique("score"), G.at_least(2, "score > 1", code="few"), G.aggregate("sum(score)", "value < 1000", code="sum"))

    got = Scores.validate([["key", "score"], ["a", "-1"], ["b", "3"], ["c", "3"], ["d", "999"]])
    assert [(d.code, d.severity, d.row) for d in got.collect_diagnostics()] == [("record_validation_failed", "error", 2), ("table_validation_failed", "error", 4), ("record_validation_failed", "warning", 5), ("sum", "error", None)]
    good = Scores.validate([["key", "score"], ["a", "2"], ["b", "300"]])
    assert good.valid and good.records.count() == 2 and [d.severity for d in good.warnings] == ["warning"]
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert Scores.parse([["key", "score"], ["a", "2"], ["b", "300"]]).count() == 2
    assert any(isinstance(w.message, G.TableWarning) for w in seen)


def test_python_hooks():
    class Hooked(G.RowTable):
        name = G.field("name", required=True)
        age: int = G.field("age", required=True)

        def validate_record(self, context):
            if self.age < context.get("least", 0):
                raise ValueError(f"{self.name} is too young")
            if self.name == "warn":
                raise G.TableError("odd name", severity="warning", row=self.source_for("name").source_row)

        @classmethod
        def validate_records(cls, records, context):
            if len({r.name for r in records}) < len(records):
                raise G.TableError("names repeat", code="repeat")

    got = Hooked.validate([["name", "age"], ["Ann", "3"], ["warn", "30"]], context={"least": 18}).collect_diagnostics()
    assert [(d.code, d.severity, d.row) for d in got] == [("record_validation_failed", "error", 2), ("table_error", "warning", 3)]
    assert [d.code for d in Hooked.validate([["name", "age"], ["a", "3"], ["a", "4"]]).collect_diagnostics()] == ["repeat"]
    assert [d.code for d in Hooked.validate([["name", "age"], ["a", "x"], ["a", "4"]]).collect_diagnostics()] == ["parser_failed"]


@dataclasses.dataclass
class Person:
    name: str
    age: int

    def __post_init__(self):
        if self.age < 0:
            raise ValueError("negative age")


def test_outputs():
    class People(G.RowTable):
        name = G.field("name", required=True)
        age: int = G.field("age", required=True)
        output_model = Person

    assert People.parse_as([["name", "age"], ["a", "1"]]) == [Person("a", 1)]
    assert People.parse_as([["name", "age"], ["a", "1"]], dict) == [{"name": "a", "age": 1}]
    with pytest.raises(G.TableError) as e:
        People.parse_as([["name", "age"], ["a", "-1"]])
    assert (e.value.code, e.value.row) == ("output_failed", 2)
    with pytest.raises(ValueError):
        Buoys.parse_as([["station", "depth m"], ["a", "1"]])
    with pytest.raises(TypeError):
        People.parse_as([], 3)

    class Built(People):
        output_model = None

        @classmethod
        def build_output(cls, record, context):
            return f"{record.name}:{context['x']}"

    assert Built.parse_as([["name", "age"], ["a", "1"]], context={"x": 5}) == ["a:5"]


class Trays(G.ColumnTable):
    """Seed trays; a column may stand for several."""

    tray = G.id_field("Tray", parser=G.integer())
    seed = G.field("Seed", required=True)
    note = G.field("Note", required=True)
    transformer = G.ColumnGroupExpander("Tray")


def test_group_expansion():
    rows = Trays.parse_records([["Tray", "12", "7..8", "20..22"], ["Seed", "rye", "2:oat", "3:flax:blue"], ["Note", "wet?", "dry", "1: kept"][:3] + ["as is"]])
    assert [(r.tray, r.seed, r.note) for r in rows] == [(12, "rye", "wet?"), (7, "oat", "dry"), (8, "oat", "dry"), *((n, "flax:blue", "as is") for n in (20, 21, 22))]
    cell = rows[4].source_for("seed")
    assert (cell.source_value, cell.source_row, cell.source_column) == ("3:flax:blue", 2, 4)
    for table, code in (
        ([["Tray", "0..10000"], ["Seed", "a"], ["Note", "b"]], "expansion_limit"),
        ([["Tray", "9..8"], ["Seed", "a"], ["Note", "b"]], "transform_failed"),
        ([["Tray", "5..9"], ["Seed", "4:a"], ["Note", "b"]], "transform_failed"),
        ([["Box", "1"], ["Seed", "a"], ["Note", "b"]], "invalid_transform"),
        ([["Tray", "1", "2"], ["Seed", "x"], ["Note", "b", "c"]], "ragged_row"),
    ):
        assert [d.code for d in Trays.validate(table).collect_diagnostics()] == [code]
    assert Trays.lenient([["Tray", "1..10000"], ["Seed", "a"], ["Note", "b"]]).records.count() == 10_000


def test_range_and_repeat_rules(spark):
    def keys(rule, text):
        r = spark.range(1).select(rule.expand(F.lit(text)).alias("e")).first()["e"]
        return list(r["items"]) if r["items"] is not None else r["code"]

    assert keys(G.NumericRange(), "7") == ["7"] and keys(G.NumericRange(), "1..x") == "transform_failed"
    assert keys(G.AlphabeticRange(), "a-c") == ["a", "b", "c"] and keys(G.AlphabeticRange(), "a-C") == "transform_failed"

    def values(rule, text, n):
        r = spark.range(1).select(rule.expand(F.lit(text), F.lit(n)).alias("e")).first()["e"]
        return list(r["items"]) if r["items"] is not None else r["error"]

    assert values(G.PrefixRepeat(), "2:a:b", 2) == ["a:b"] * 2 and values(G.PrefixRepeat(), "x:a", 2) == ["x:a"] * 2
    assert values(G.SuffixRepeat(), "a x1 x2", 2) == ["a x1"] * 2 and "empty" in values(G.SuffixRepeat(), " x2", 2)
    with pytest.raises(ValueError):
        G.NumericRange("")


def test_transformers_keep_sources():
    class Shout:
        def transform(self, cells, context, *, schema=None):
            return cells.map_values(F.upper)

    class Loud(G.RowTable):
        x = G.field("X", parser=G.integer())
        transformer = G.compose_transformers(Shout(), Shout())

    d = Loud.validate([["x"], ["ab"]]).collect_diagnostics()[0]
    assert (d.source_value, d.logical_value) == ("ab", "AB")

    class Broken:
        def transform(self, cells, context, *, schema=None):
            raise RuntimeError("no")

    class Wrong:
        def transform(self, cells, context, *, schema=None):
            return [["x"]]

    for step, code in ((Broken(), "transform_failed"), (Wrong(), "invalid_transform")):
        schema = type(G.RowTable)("S", (G.RowTable,), {"x": G.field("x"), "transformer": step, "__module__": __name__})
        assert [d.code for d in schema.validate([["x"], ["1"]]).collect_diagnostics()] == [code]


def test_cell_dsl():
    dsl = G.CellDSL()
    dsl.token("now", to="global").token("now", fields="x", to="scoped").pattern(r"(?P<a>\d+)-(?P<b>\d+)", to=lambda g: F.concat(g("b"), F.lit("/"), g("a")))
    dsl.pattern(r"\d+.*", to="digits").when(lambda c: F.length(c) > 5, to="long")
    other = G.CellDSL()

    @other.token("py")
    def py(context):
        return f"python {context.row}"

    @other.fallback
    def rest(text, context):
        if text == "boom":
            raise ValueError("bang")
        return text + "?"

    class Words(G.RowTable):
        x = G.field("x", parser=dsl | other)
        y = G.field("y", parser=dsl)

    rows = Words.parse_records([["x", "y"], ["now", "now"], ["1-2", "7"], ["abcdefg", "same"], ["py", "a"], ["b", "b"]])
    assert [(r.x, r.y) for r in rows] == [("scoped", "global"), ("2/1", "digits"), ("long", "same"), ("python 5", "a"), ("b?", "b")]
    assert [(d.code, d.row) for d in Words.validate([["x"], ["boom"]]).collect_diagnostics()] == [("parser_failed", 2)]
    with pytest.raises(ValueError):
        dsl.token("now", to="again")
    with pytest.raises(ValueError):
        other.fallback(to="x")
    with pytest.raises(ValueError):
        dsl.token("", to="x")


def test_cells_and_sources(spark, tmp_path):
    cells = G.CellFrame.from_rows([["a", "b"], ["1", "2"]], source=tmp_path / "t.csv")
    c = cells.cell(2, 1)
    assert (c.value, c.source_row, c.source_column, c.source_uri) == ("1", 2, 1, (tmp_path / "t.csv").resolve().as_uri())
    assert cells.to_rows() == [["a", "b"], ["1", "2"]]
    with pytest.raises(IndexError):
        cells.cell(0, 1)
    with pytest.raises(IndexError):
        cells.cell(3, 1)
    with pytest.raises(ValueError):
        G.TableCell("x", 0, 1)
    with pytest.raises(TypeError):
        G.TableCell("x", True, 1)
    d = Buoys.validate(G.CellFrame.from_rows([["station", "depth m"], ["a", "x"]], source="memory:1")).collect_diagnostics()[0]
    assert d.source_uri == "memory:1"
    (tmp_path / "u.csv").write_text("depth m,station\n3,P\n44,Q\n")
    rows = Buoys.parse_records(G.read_tables(spark, str(tmp_path / "u.csv")))
    assert [(r.station, r.depth, r.source_for("depth").source_row) for r in rows] == [("P", 3, 2), ("Q", 44, 3)]


def test_wide_frames_push_down(spark, tmp_path):
    spark.createDataFrame([(str(i), str(i % 5), "z", i) for i in range(20)], "station string, `depth m` string, sensors string, n long").write.parquet(str(tmp_path / "t"))
    got = Buoys.lenient(spark.read.parquet(str(tmp_path / "t")), ordinal="n")
    plan = got.records.select("depth").filter("depth = 3")._jdf.queryExecution().executedPlan().toString()
    assert "sensors" not in plan.split("ReadSchema")[1]
    assert "Window" not in plan and "Exchange" not in plan
    assert got.records.filter("depth = 3").count() == 4


def test_many_tables_have_their_own_barriers(spark):
    one = G.CellFrame.from_rows([["station", "depth m"], ["a", "1"]], table_id="good")
    two = G.CellFrame.from_rows([["station", "depth m"], ["b", "x"], ["c", "2"]], table_id="bad")
    got = Buoys.validate(G.CellFrame(one.df.unionByName(two.df)))
    assert [(r["station"], r["_table_id"]) for r in got.records.collect()] == [("a", "good")]


def test_frames_whose_order_counts_must_number_their_rows(spark):
    class Keyed(G.RowTable):
        key: int = G.id_field("key")

    class Alone(G.RowTable):
        key: int = G.field("key", required=True)
        checks = (G.unique("key"),)

    class Linked(G.RowTable):
        key: int = G.field("key", required=True)
        near = G.reference("near", target="key", many=True)

    df = spark.createDataFrame([("1", 3), ("1", 2), ("2", 1)], "key string, n int")
    for schema in (Keyed, Alone, Linked):
        with pytest.raises(G.TableError) as e:
            schema.lenient(df.drop("n"))
        assert e.value.code == "invalid_table_input"
        assert [c for c, *_ in found(schema.validate(df.drop("n")))] == ["invalid_table_input"]
    got = Keyed.lenient(df, ordinal="n")
    # The first of equal ids is kept, and only the other is reported.
    assert sorted((r["key"], r["_ordinal"]) for r in got.records.collect()) == [(1, 2), (2, 1)]
    assert found(got) == [("duplicate_id", 3, 1)]
    assert found(Alone.lenient(df, ordinal="n")) == [("table_validation_failed", 3, 1)]


def test_tables_of_one_frame_have_their_own_headers_and_hooks(spark):
    df = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "t string, key string, what string")

    class Keys(G.RowTable):
        key: int = G.field("key", required=True)

    got = Keys.validate(df, table_id="t")
    assert not got.valid and got.records.count() == 0
    assert sorted((r["_table_id"], r["code"]) for r in got.diagnostics.collect()) == [("a", "unknown_field"), ("b", "unknown_field")]
    calls = []

    class Hooked(G.RowTable):
        key: int = G.field("key", required=True)

        @classmethod
        def validate_records(cls, records, context):
            calls.append([r.key for r in records])
            if records[0].key == 1:
                raise G.TableError("one", code="mine")

    got = Hooked.validate(df.drop("what"), table_id="t")
    assert calls == [[1], [2]]
    assert [(r["_table_id"], r["code"]) for r in got.diagnostics.collect()] == [("a", "mine")]
    assert [r["key"] for r in got.records.collect()] == [2]


def test_aggregates_of_validators():
    class Scores(G.RowTable):
        score: int = G.field("score", required=True)

        def validate_record(self, context):
            severity = "warning" if self.score > 8 else "error"
            if self.score > 4:
                raise G.TableErrors([G.TableError("low", code="low"), G.TableError("high", code="high", severity=severity)])
            if self.score > 2:
                raise G.TableError("early", code="early")

    def codes(*scores):
        return [d.code for d in Scores.validate([["score"], *([str(x)] for x in scores)]).collect_diagnostics()]

    # One with a warning in it is taken apart; one of errors only is raised as it is, by itself.
    assert codes(9, 3) == ["low", "high", "early"]
    assert codes(3, 5, 6) == ["low", "high"]
    assert codes(1, 3) == ["early"]
    with pytest.raises(G.TableErrors) as e:
        Scores.parse([["score"], ["3"], ["5"]], error_mode="collect")
    assert [d.code for d in e.value.diagnostics] == ["low", "high"]


def test_diagnostics_are_plain_data():
    loop: list = []
    loop.append(loop)
    data = G.stable_json({"a": float("nan"), "b": {2, 1}, "c": Hull.WOOD, "d": {1: "x"}, "e": Decimal("1.50"), "f": object(), "g": loop})
    assert data["a"] == {"type": "float", "value": "nan"} and data["b"] == [1, 2] and data["c"]["name"] == "WOOD"
    assert data["d"] == {"type": "mapping", "entries": [[1, "x"]]} and data["e"] == "1.50" and data["f"] == {"type": "builtins.object"} and data["g"] == [{"type": "builtins.list"}]
    d = Diagnostic("x", "m", _item_id=None)
    assert d.has_item_id and not d.has_source_value and list(d.as_dict())[:3] == ["diagnostic_version", "severity", "code"] and len(d.as_dict()) == 17
    cell = G.TableCell("v", 2, 3, "s")
    assert "row=2" in str(G.TableError.from_cell(cell, "m", code="c")) and len(G.CODES) == 27


def test_describe(spark):
    c = Fleet.describe()
    assert [f.name for f in c.fields] == ["hull_no", "drive", "home"] and [v.value for v in c.variants] == ["sail", "motor"]
    assert c.as_dict()["fields"][0]["is_id"] is True
    assert c.to_frame(spark).count() == 3 + 4 + 4
    assert "split" in {f.name: f for f in Buoys.describe().fields}["sensors"].parser


def test_functional_api():
    assert G.parse_table(Buoys, [["station", "depth m"], ["a", "1"]]).count() == 1
    assert G.parse_table_as(Buoys, [["station", "depth m"], ["a", "1"]], dict)[0]["depth"] == 1
    assert G.validate_table(Buoys, [["station", "depth m"], ["a", "1"]]).valid
    assert [c for c, *_ in found(Buoys.validate([["station", "depth m"]], context=3))] == ["invalid_context"]
    assert all(hasattr(G, n) for n in G.__all__)
