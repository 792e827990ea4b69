"""Feature files, static checks, the command line and streams."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import gridsmith as G
from gridsmith.checker import check_feature, check_feature_tables
from gridsmith.cli import main
from gridsmith.sources.features import discover_feature_tables, read_features
from gridsmith.streaming import tables as S

pytestmark = pytest.mark.usefixtures("spark")

FEATURE = """\
# a comment
Feature: Checks

  Background: Base
    Given some users:
      | name | age |
      | Ann  | 1   |

  Scenario Outline: Users
    Given the users:
      | name   | age   | token     |
      | <name> | <age> | user-<id> |

    Examples: One
      | name  | age | id |
      | Alice | old | 1  |
      | Bob   | 2   | 2  |

    Examples: Two
      | name  | age | id |
      | Carol | 3   | 3  |

  Rule: More
    Scenario: Odd
      When text
        \"\"\"
        | not | a table |
        \"\"\"
      Then cells:
        | a\\|b | |
"""
SCHEMA = """\
from gridsmith import RowTable, field, integer


class Users(RowTable):
    name = field("name", required=True)
    age = field("age", required=True, parser=integer())
    token = field("token")


def context():
    return {"a": 1}


def bad_context():
    return 3
"""


@pytest.fixture
def files(tmp_path):
    (tmp_path / "a.feature").write_text(FEATURE)
    (tmp_path / "schemas.py").write_text(SCHEMA)
    return tmp_path


class Users(G.RowTable):
    name = G.field("name", required=True)
    age = G.field("age", required=True, parser=G.integer())
    token = G.field("token")


def test_discovery(files):
    found = discover_feature_tables(files / "a.feature", step="the users:")
    assert [t.to_rows()[1] for t in found] == [["Alice", "old", "user-1"], ["Bob", "2", "user-2"], ["Carol", "3", "user-3"]]
    exact, mixed = found[0].cell(2, 1), found[0].cell(2, 3)
    assert (exact.source_row, exact.source_value) == (16, "Alice") and (mixed.source_row, mixed.source_value) == (12, "user-<id>")
    odd = discover_feature_tables(files / "a.feature", scenario="Odd")
    assert [t.to_rows() for t in odd] == [[["a|b", ""]]]
    assert len(discover_feature_tables(files / "a.feature")) == 5


def test_source(files, spark):
    cells = read_features([files / "a.feature"], step="the users:")
    assert cells.select("table_id").distinct().count() == 3
    assert read_features([files / "a.feature"]).filter(F.col("scenario") == "Base").count() == 4


def test_checks(files):
    found = check_feature(files / "a.feature", schema=Users, step="the users:")
    assert [(x.diagnostic.code, x.diagnostic.row, x.diagnostic.column, x.scenario) for x in found] == [("parser_failed", 16, 17, "Users")]
    again = check_feature_tables(discover_feature_tables(files / "a.feature", step="the users:"), schema=Users)
    assert [x.diagnostic.code for x in again] == ["parser_failed"]
    with pytest.raises(G.TableError) as e:
        discover_feature_tables(files / "none.feature")
    assert e.value.code == "checker_failed"


GERMAN = """\
# language: de
Funktionalität: Bojen
  Grundlage: immer
    Angenommen die Bojen:
      | Ort | Tiefe |
      | Nord | 7    |
  Szenariogrundriss: je eine
    Wenn eine Boje:
      | Ort | Tiefe |
      | <o> | <t>   |
    Beispiele:
      | o  | t  |
      | Ost | 40 |
"""


def test_keywords_of_other_languages(tmp_path, spark):
    (tmp_path / "b.feature").write_text(GERMAN, encoding="utf-8")
    (tmp_path / "c.feature").write_text("# language: xx\nFeature: x\n")
    found = discover_feature_tables(tmp_path / "b.feature")
    assert [(t.feature, t.scenario, t.step, t.to_rows()[1]) for t in found] == [("Bojen", "immer", "die Bojen:", ["Nord", "7"]), ("Bojen", "je eine", "eine Boje:", ["Ost", "40"])]
    # Through Spark's own file reader, which any file system has, the same cells.
    cells = G.read_feature_files(str(tmp_path / "b.feature"), step="eine Boje:")
    assert sorted(r["value"] for r in cells.collect()) == ["40", "Ort", "Ost", "Tiefe"]
    assert sorted(r["source_row"] for r in cells.select("source_row").distinct().collect()) == [9, 13]
    with pytest.raises(G.TableError):
        discover_feature_tables(tmp_path / "c.feature")


def test_command_line(files, capsys):
    schema = f"{files}/schemas.py:Users"
    assert main(["check", f"{files}/a.feature", "--schema", schema, "--step", "the users:"]) == 1
    assert "Found 1 table error(s)" in capsys.readouterr().out
    assert main(["check", f"{files}/a.feature", "--schema", schema, "--step", "some users:", "--format", "json", "--context-factory", f"{files}/schemas.py:context"]) == 0
    out = json.loads(capsys.readouterr().out)
    assert (out["status"], out["matched_tables"], out["error_count"]) == ("valid", 1, 0)
    assert main(["check", f"{files}/a.feature", "--schema", schema, "--step", "nothing"]) == 2
    capsys.readouterr()
    for args in (["--schema", "nope:X"], ["--schema", f"{files}/schemas.py:context"], ["--schema", schema, "--context-factory", f"{files}/schemas.py:bad_context"]):
        assert main(["check", f"{files}/a.feature", "--format", "json", *args]) == 1
        assert json.loads(capsys.readouterr().out)["diagnostics"][0]["code"] == "checker_failed"
    (files / "bad.feature").write_text("Scenario: no feature\n")
    assert main(["check", f"{files}/bad.feature", "--schema", schema]) == 1
    assert main(["describe", schema]) == 0
    assert "age: label='age', type=bigint" in capsys.readouterr().out.split("Feature discovery")[-1]
    assert main(["describe", schema, "--format", "json"]) == 0
    assert json.loads(capsys.readouterr().out)["fields"][1]["type"] == "bigint"


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", "1", "x", "2026-01-01 00:00:00"), ("b", "?", "x", "2026-01-01 00:00:30"), ("c", "3", "x", "2026-01-01 00:01:00")], "name string, age string, token string, ts string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string, age string, token string, ts string").parquet(str(tmp_path / "in"))
    typed = S.stateless(Users, stream.select("name", "age", "token"))
    q = S.good(typed).select("name", "age").writeStream.format("memory").queryName("typed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("typed").collect())) == [("a", 1), ("c", 3)]
    seen = []
    q = S.each_batch(Users, stream.select("name", "age", "token"), lambda result, n: seen.append(result.counts)).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert seen == [(1, 0)]

    class Keyed(G.RowTable):
        key = G.id_field("key")

    with pytest.raises(G.SchemaDefinitionError):
        S.stateless(Keyed, stream)


@pytest.mark.parametrize("removed", [(), ("gridsmith/llm", "tests/llm"), ("corpus_pipeline.py",), ("gridsmith/llm", "corpus_pipeline.py")])
def test_entry_with_and_without_the_corpus_operators(tmp_path, removed):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "gridsmith", tmp_path / "gridsmith", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    for name in removed:
        path = tmp_path / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*q)"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.split()
    assert "flagship_orders" in said
    there = (tmp_path / "gridsmith/llm/queries.py").exists()
    assert any(x.startswith("op") for x in said) == there
    assert ("pipeline" in said) == (there and (tmp_path / "corpus_pipeline.py").exists())


def test_entry_hides_no_import_error(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "gridsmith", tmp_path / "gridsmith", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    (tmp_path / "gridsmith/llm").mkdir()
    (tmp_path / "gridsmith/llm/__init__.py").touch()
    (tmp_path / "gridsmith/llm/queries.py").write_text("import no_such_module\n")
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode and "no_such_module" in said.stderr
