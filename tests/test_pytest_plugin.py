"""The pytest fixture, with steps as pytest-bdd hands them over."""

from types import SimpleNamespace as N

import pytest

import gridsmith as G
from gridsmith import pytest_plugin as P

pytestmark = pytest.mark.usefixtures("spark")


class Users(G.RowTable):
    name = G.field("name", required=True)
    age: int = G.field("age", required=True)


def test_tables_of_steps_are_placed_in_their_file():
    parser = P.TableParser()
    rows = [["name", "age"], ["Ann", "old"]]
    request = N(fixturenames=["table_parser"], getfixturevalue=lambda name: parser)
    cell = lambda line, column: N(location=N(line=line, column=column))
    step = N(datatable=N(rows=[N(cells=[cell(7, 9), cell(7, 16)]), N(cells=[cell(8, 9), cell(8, 16)])]))
    P.pytest_bdd_before_step_call(request, N(filename="a.feature"), None, step, None, {"datatable": rows})
    d = parser.validate(Users, rows).collect_diagnostics()[0]
    assert (d.code, d.row, d.column, d.source_uri) == ("parser_failed", 8, 16, "a.feature")
    P.pytest_bdd_after_step(request, None, None, step, None, {})
    assert parser.validate(Users, rows).collect_diagnostics()[0].row == 2
    P.pytest_bdd_before_step_call(request, N(filename="a.feature"), None, N(datatable=N(rows=[])), None, {"datatable": rows})
    assert not parser.bound
    assert parser.parse(Users, [["name", "age"], ["Ann", "3"]])[0].age == 3
    assert parser.parse_as(Users, [["name", "age"], ["Ann", "3"]], dict) == [{"name": "Ann", "age": 3}]
