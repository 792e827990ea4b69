"""Static checks of feature files: all tables of all files in one job."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import functions as F

from .api import strict
from .diagnostics import Diagnostic, from_row
from .sources.features import FeatureTable, cells_of, discover_feature_tables, read_features


@dataclass(frozen=True)
class FeatureDiagnostic:
    """A diagnostic and the table it is about."""

    path: Path
    feature: str
    scenario: str
    step: str
    diagnostic: Diagnostic


def check_files(paths: Any, *, schema: type, step: str | None = None, scenario: str | None = None, context: Any = None) -> tuple[int, list[FeatureDiagnostic]]:
    """How many tables matched, and what is wrong with them. Output is not built."""
    files = [paths] if isinstance(paths, (str, Path)) else list(paths)
    # Unreadable files are told before a job begins.
    found = [t for p in files for t in discover_feature_tables(p, step=step, scenario=scenario)]
    if not found:
        return 0, []
    cells = read_features(files, step=step, scenario=scenario)
    places = cells.select("table_id", "path", "feature", "scenario", "step").distinct()
    result = strict(schema, cells_of(cells), context=context)
    # Both sides have a column named step.
    named = result.diagnostics.withColumnRenamed("step", "_step").join(places, F.col("_table_id") == F.col("table_id"))
    rows = named.orderBy("_table_id", "phase", "record_ordinal", "_step", "step_ordinal")
    return len(found), [FeatureDiagnostic(Path(r["path"]), r["feature"], r["scenario"], r["step"], from_row(r)) for r in rows.collect()]


def check_feature(path: Any, *, schema: type, step: str | None = None, scenario: str | None = None, context: Any = None) -> list[FeatureDiagnostic]:
    return check_files(path, schema=schema, step=step, scenario=scenario, context=context)[1]


def check_feature_tables(tables: list[FeatureTable], *, schema: type, context: Any = None) -> list[FeatureDiagnostic]:
    """The diagnostics of tables found before."""
    out = []
    for t in tables:
        got = schema.validate([list(r) for r in t.rows], context=context)
        out += [FeatureDiagnostic(t.path, t.feature, t.scenario, t.step, d) for d in got.collect_diagnostics()]
    return out
