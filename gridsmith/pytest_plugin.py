"""A pytest fixture over schemas: pytest_plugins = ["gridsmith.pytest_plugin"].

With pytest-bdd, a step's data table is known by its rows object while the step runs, so that diagnostics name lines and columns of the
feature file. Where the places don't fit the rows, the rows are read as they are.
"""

from __future__ import annotations

from typing import Any

import pytest

from .sources.cells import CellFrame, TableCell


class TableParser:
    """The lifecycle of schemas, for tables of the step at hand."""

    def __init__(self) -> None:
        self.bound: dict[int, list[list[TableCell]]] = {}

    def bind(self, rows: Any, cells: Any, uri: str | None) -> None:
        """Notes the file places of rows: cells have a line and a column for each of them."""
        if len(rows) != len(cells) or any(len(a) != len(b) for a, b in zip(rows, cells)):
            return
        self.bound[id(rows)] = [[TableCell(v, c[0], c[1], v, uri) for v, c in zip(a, b)] for a, b in zip(rows, cells)]

    def clear(self) -> None:
        self.bound.clear()

    def source(self, table: Any) -> Any:
        cells = self.bound.get(id(table))
        return table if cells is None else CellFrame.from_cells(cells)

    def parse(self, schema: type, table: Any, **options: Any) -> Any:
        return schema.parse_records(self.source(table), **options)

    def parse_as(self, schema: type, table: Any, output_model: Any = None, **options: Any) -> Any:
        return schema.parse_as(self.source(table), output_model, **options)

    def validate(self, schema: type, table: Any, **options: Any) -> Any:
        return schema.validate(self.source(table), **options)


@pytest.fixture
def table_parser() -> TableParser:
    return TableParser()


def parser_of(request: Any) -> TableParser | None:
    return request.getfixturevalue("table_parser") if "table_parser" in getattr(request, "fixturenames", ()) else None


@pytest.hookimpl(optionalhook=True)
def pytest_bdd_before_step_call(request, feature, scenario, step, step_func, step_func_args):
    rows, table, parser = step_func_args.get("datatable"), getattr(step, "datatable", None), parser_of(request)
    if parser is None or rows is None or table is None:
        return
    try:
        places = [[(c.location.line, c.location.column) for c in r.cells] for r in table.rows]
    except AttributeError:
        return
    name = getattr(feature, "filename", None)
    parser.bind(rows, places, None if name is None else str(name))


def clear(request: Any) -> None:
    if (parser := parser_of(request)) is not None:
        parser.clear()


@pytest.hookimpl(optionalhook=True)
def pytest_bdd_after_step(request, feature, scenario, step, step_func, step_func_args):
    clear(request)


@pytest.hookimpl(optionalhook=True)
def pytest_bdd_step_error(request, feature, scenario, step, step_func, step_func_args, exception):
    clear(request)
