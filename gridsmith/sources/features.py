"""Data tables of Gherkin feature files as cells: a parser of our own, a Spark data source, and outline expansion.

One file is read as a whole by one task, which feature files are small enough for; any number of files is read in parallel. Columns
of the source: path, feature, scenario, step, table_id and those of CELL_SCHEMA. Coordinates are lines and columns of the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from ..diagnostics import TableError
from .cells import CELL_SCHEMA, CellFrame, TableCell, session, source_uri

FEATURE_SCHEMA = T.StructType([*(T.StructField(n, T.StringType()) for n in ("path", "feature", "scenario", "step")), *CELL_SCHEMA.fields])

# The keywords of feature files, by the language that a first line "# language: .." names; English without one.
KEYWORDS = {
    "en": {"feature": "Feature", "rule": "Rule", "background": "Background", "outline": "Scenario Outline|Scenario Template", "scenario": "Scenario|Example", "examples": "Examples|Scenarios", "step": "Given|When|Then|And|But"},
    "de": {"feature": "Funktionalität|Funktion", "rule": "Rule|Regel", "background": "Grundlage|Hintergrund|Voraussetzungen|Vorbedingungen", "outline": "Szenariogrundriss|Szenarien", "scenario": "Beispiel|Szenario", "examples": "Beispiele", "step": "Angenommen|Gegeben sei|Gegeben seien|Wenn|Dann|Und|Aber"},
    "fr": {"feature": "Fonctionnalité", "rule": "Règle", "background": "Contexte", "outline": "Plan du scénario|Plan du Scénario", "scenario": "Exemple|Scénario", "examples": "Exemples", "step": "Soit|Sachant que|Étant donné que|Étant donné|Quand|Lorsque|Alors|Donc|Et que|Et|Mais que|Mais"},
    "es": {"feature": "Característica|Necesidad del negocio|Requisito", "rule": "Regla|Regla de negocio", "background": "Antecedentes", "outline": "Esquema del escenario", "scenario": "Ejemplo|Escenario", "examples": "Ejemplos", "step": "Dado|Dada|Dados|Dadas|Cuando|Entonces|Y|E|Pero"},
}
LANGUAGE = re.compile(r"#\s*language\s*:\s*([A-Za-z_-]+)")


def grammar(language: str) -> tuple[re.Pattern, re.Pattern, dict[str, str]]:
    """(steps, block headings, the kind of each heading) of a language's files."""
    words = KEYWORDS.get(language)
    if words is None:
        raise ValueError(f"keywords of the language {language!r} are not known; known are {sorted(KEYWORDS)}")
    kinds = {w: kind for kind, names in words.items() if kind != "step" for w in names.split("|")}
    longest = sorted(kinds, key=len, reverse=True)
    steps = sorted(words["step"].split("|"), key=len, reverse=True)
    return re.compile(rf"({'|'.join(steps)}|\*)\s+(.*)"), re.compile(rf"({'|'.join(longest)})\s*:\s*(.*)"), kinds


PARAMETER = re.compile(r"<([^<>]+)>")


@dataclass
class Step:
    text: str
    rows: list[list[tuple[str, int, int]]] = field(default_factory=list)  # (text, line, column)


@dataclass
class Scenario:
    name: str
    outline: bool = False
    steps: list[Step] = field(default_factory=list)
    examples: list[list[list[tuple[str, int, int]]]] = field(default_factory=list)


@dataclass(frozen=True)
class FeatureTable:
    """One data table and where it stands."""

    path: Path
    feature: str
    scenario: str
    step: str
    rows: tuple[tuple[TableCell, ...], ...]

    def to_rows(self) -> list[list[str]]:
        return [[c.value for c in r] for r in self.rows]

    def cell(self, row: int, column: int) -> TableCell:
        if row < 1 or column < 1:
            raise IndexError("cells are counted from 1")
        return self.rows[row - 1][column - 1]


def table_row(line: str, number: int) -> list[tuple[str, int, int]]:
    """The cells of a line |a|b|: trimmed, with \\|, \\\\ and \\n unescaped, and the column each begins at."""
    out, text, start, i = [], "", line.index("|") + 1, line.index("|") + 1
    while i < len(line):
        ch = line[i]
        if ch == "\\" and i + 1 < len(line) and line[i + 1] in "|\\n":
            text += "\n" if line[i + 1] == "n" else line[i + 1]
            i += 2
            continue
        if ch == "|":
            raw = line[start:i]
            lead = len(raw) - len(raw.lstrip())
            out.append((text.strip(" \t\r"), number, start + (lead if raw.strip() else min(1, len(raw))) + 1))
            text, start = "", i + 1
        else:
            text += ch
        i += 1
    if line[start:].strip():
        raise ValueError(f"line {number}: a table row must end with |")
    return out


def parse_feature(text: str) -> tuple[str, list[Scenario]]:
    """The feature's name and its scenarios and backgrounds, those of rules included, in order."""
    name: str | None = None
    scenarios: list[Scenario] = []
    current: Scenario | None = None
    rows: list | None = None
    closing: str | None = None
    lines = text.split("\n")
    told = next((m[1] for x in lines if (m := LANGUAGE.fullmatch(x.strip()))), "en") if text.lstrip().startswith("#") else "en"
    steps, blocks, kinds = grammar(told)
    for number, line in enumerate(lines, 1):
        bare = line.strip()
        if closing is not None:
            closing = None if bare == closing else closing
            continue
        if bare.startswith(('"""', "```")):
            if current is None or not current.steps:
                raise ValueError(f"line {number}: a doc string without a step")
            closing = bare[:3]
            continue
        if not bare or bare.startswith(("#", "@")):
            continue
        if bare.startswith("|"):
            if rows is None:
                raise ValueError(f"line {number}: a table row without a step")
            row = table_row(line, number)
            if rows and len(row) != len(rows[0]):
                raise ValueError(f"line {number}: inconsistent cell count within the table")
            rows.append(row)
            continue
        rows = None
        if m := blocks.fullmatch(bare):
            kind, title = kinds[m[1]], m[2].strip()
            if kind == "feature":
                if name is not None:
                    raise ValueError(f"line {number}: a second feature")
                name = title
            elif name is None:
                raise ValueError(f"line {number}: expected a feature")
            elif kind == "examples":
                if current is None or not current.outline:
                    if current is None:
                        raise ValueError(f"line {number}: examples without an outline")
                    current.outline = True
                rows = []
                current.examples.append(rows)
            elif kind != "rule":
                current = Scenario(title, kind == "outline")
                scenarios.append(current)
            else:
                current = None
        elif (m := steps.fullmatch(bare)) and current is not None:
            current.steps.append(Step(m[2].strip()))
            rows = current.steps[-1].rows
        elif name is None or (current is not None and current.steps):
            raise ValueError(f"line {number}: unexpected text {bare!r}")
    if closing is not None:
        raise ValueError("a doc string isn't closed")
    return name or "", scenarios


def tables_of(text: str, path: str, uri: str, step: str | None = None, scenario: str | None = None) -> Iterator[FeatureTable]:
    """The matching tables; one of an outline for each row of its examples."""
    feature, scenarios = parse_feature(text)
    make = lambda value, cell, source: TableCell(value, cell[1], cell[2], source, uri)
    for s in scenarios:
        if scenario is not None and s.name != scenario:
            continue
        used = [x for x in s.steps if x.rows and (step is None or x.text == step)]
        if not s.examples:
            for x in used:
                yield FeatureTable(Path(path), feature, s.name, x.text, tuple(tuple(make(c[0], c, c[0]) for c in r) for r in x.rows))
            continue
        for block in s.examples:
            for example in block[1:]:
                given = {h[0]: c for h, c in zip(block[0], example)}
                for x in used:
                    out = []
                    for r in x.rows:
                        row = []
                        for c in r:
                            whole = PARAMETER.fullmatch(c[0])
                            if whole and whole[1] in given:
                                # The cell is the example's: that is where it was written.
                                e = given[whole[1]]
                                row.append(make(e[0], e, e[0]))
                            else:
                                row.append(make(PARAMETER.sub(lambda m: given[m[1]][0] if m[1] in given else m[0], c[0]), c, c[0]))
                        out.append(tuple(row))
                    yield FeatureTable(Path(path), feature, s.name, x.text, tuple(out))


def discover_feature_tables(path: Any, *, step: str | None = None, scenario: str | None = None) -> list[FeatureTable]:
    """The tables of one feature file, on the driver."""
    where = Path(path)
    try:
        return list(tables_of(where.read_text(encoding="utf-8"), str(where), source_uri(where), step, scenario))
    except Exception as e:
        raise TableError(f"Feature discovery failed for {where}: {e}", code="checker_failed", source_uri=where.resolve().as_uri(), cause=e) from e


@dataclass
class OneFile(InputPartition):
    path: str

    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class FeatureReader(DataSourceReader):
    def __init__(self, paths: list[str], options: dict[str, str]):
        self.paths, self.wanted = paths, {k: options[k] for k in ("step", "scenario") if k in options}

    def pushFilters(self, filters):  # noqa: N802 - Spark's name
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("step",), ("scenario",)) and f.attribute[0] not in self.wanted:
                self.wanted[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self):
        return [OneFile(p) for p in self.paths]

    def read(self, partition):
        path = partition.path
        tables = discover_feature_tables(path, **self.wanted)
        for n, t in enumerate(tables):
            for i, row in enumerate(t.rows, 1):
                for j, c in enumerate(row, 1):
                    yield (path, t.feature, t.scenario, t.step, f"{path}#{n:06d}", i, j, c.value, c.source_row, c.source_column, c.source_value, c.source_uri)


class FeatureSource(DataSource):
    """spark.read.format("feature").option("paths", "a.feature,b.feature") or .load(path); options step and scenario filter."""

    @classmethod
    def name(cls):
        return "feature"

    def schema(self):
        return FEATURE_SCHEMA

    def reader(self, schema):
        paths = [p for p in (self.options.get("paths") or self.options.get("path") or "").split(",") if p]
        return FeatureReader(paths, dict(self.options))


def read_features(paths: Any, *, step: str | None = None, scenario: str | None = None, spark: SparkSession | None = None) -> DataFrame:
    """The cells of feature files' tables, with the place of each table."""
    spark = spark or session()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FeatureSource)
    names = [str(paths)] if isinstance(paths, (str, Path)) else [str(p) for p in paths]
    reader = spark.read.format("feature").option("paths", ",".join(names))
    for k, v in (("step", step), ("scenario", scenario)):
        if v is not None:
            reader = reader.option(k, v)
    return reader.load()


def feature_tables(files: DataFrame, *, step: str | None = None, scenario: str | None = None) -> DataFrame:
    """The cells of feature files given as rows (path, content: text or UTF-8 bytes), as read_features() has them."""
    wanted = {"step": step, "scenario": scenario}

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = content.decode("utf-8") if isinstance(content, bytes) else content
                try:
                    tables = list(tables_of(text or "", path, path, **wanted))
                except Exception as e:
                    raise TableError(f"Feature discovery failed for {path}: {e}", code="checker_failed", source_uri=path) from e
                for n, t in enumerate(tables):
                    cells = ((i, j, c) for i, row in enumerate(t.rows, 1) for j, c in enumerate(row, 1))
                    rows += [(path, t.feature, t.scenario, t.step, f"{path}#{n:06d}", i, j, c.value, c.source_row, c.source_column, c.source_value, path) for i, j, c in cells]
            columns = list(zip(*rows)) if rows else [()] * len(FEATURE_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    arrow = to_arrow_schema(FEATURE_SCHEMA)
    return files.select("path", "content").mapInArrow(run, FEATURE_SCHEMA)


def read_feature_files(paths: Any, *, spark: SparkSession | None = None, **filters: Any) -> DataFrame:
    """read_features() through Spark's file reader: any file system, folders and patterns included."""
    names = [str(paths)] if isinstance(paths, (str, Path)) else [str(p) for p in paths]
    return feature_tables((spark or session()).read.format("binaryFile").load(names), **filters)


def cells_of(features: DataFrame) -> CellFrame:
    return CellFrame(features.select(*(F.col(f.name) for f in CELL_SCHEMA)))
