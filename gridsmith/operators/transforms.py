"""Table transformers: cells to cells, in turn, before a table is read by its orientation."""

from __future__ import annotations

from typing import Any, Protocol

from ..diagnostics import SchemaDefinitionError, TableError, TableErrors
from ..sources.cells import COLUMNS, CellFrame


class TableTransformer(Protocol):
    def transform(self, cells: CellFrame, context: Any, *, schema: Any = None) -> CellFrame: ...


def run_transformers(steps: Any, cells: CellFrame, context: Any, schema: Any) -> CellFrame:
    """All steps, left to right; a failure names the step."""
    many = len(steps) > 1
    for i, step in enumerate(steps, 1):
        name = f"Transformer {i} ({type(step).__name__})" if many else f"Transformer {type(step).__name__}"
        try:
            out = step.transform(cells, context, schema=schema)
        except (TableError, TableErrors, SchemaDefinitionError):
            raise
        except Exception as e:
            raise TableError(f"{name} failed: {e}", schema=schema, code="transform_failed", source_uri=cells.uri, cause=e) from e
        cells = checked(out, cells, schema, name)
    return cells


def checked(out: Any, before: CellFrame, schema: Any, name: str = "Table transformation") -> CellFrame:
    """What a transformation returned, if it is a frame of cells with provenance."""
    if not isinstance(out, CellFrame) or any(c not in out.df.columns for c in COLUMNS):
        raise TableError(f"{name} must return a CellFrame with the columns of cells", schema=schema, code="invalid_transform", source_uri=before.uri)
    return out.with_source(before.uri) if out.uri is None and before.uri is not None and out is not before else out


class TransformerPipeline:
    """Transformers as one."""

    def __init__(self, *steps: Any):
        if not steps:
            raise ValueError("a pipeline needs a transformer")
        if not all(callable(getattr(s, "transform", None)) for s in steps):
            raise TypeError("a transformer needs a method transform()")
        self.steps = steps

    def transform(self, cells: CellFrame, context: Any, *, schema: Any = None) -> CellFrame:
        return run_transformers(self.steps, cells, context, schema)


def compose_transformers(*steps: Any) -> TransformerPipeline:
    return TransformerPipeline(*steps)
