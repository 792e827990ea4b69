"""What hooks are told: the user's data, and the cell or record at hand."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from types import MappingProxyType
from typing import Any

from .diagnostics import TableError


@dataclass(frozen=True)
class ParseContext:
    """Read-only user data of one run."""

    user_data: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        object.__setattr__(self, "user_data", MappingProxyType(dict(self.user_data)))

    def __getitem__(self, key: str) -> Any:
        return self.user_data[key]

    def get(self, key: str, default: Any = None) -> Any:
        return self.user_data.get(key, default)

    def __reduce__(self):
        return ParseContext, (dict(self.user_data),)

    @classmethod
    def of(cls, value: Any, schema: Any = None) -> ParseContext:
        if isinstance(value, ParseContext):
            return value
        if value is None:
            return cls()
        if not isinstance(value, Mapping):
            raise TableError(f"Context must be a mapping, not {type(value).__name__}", schema=schema, code="invalid_context")
        return cls(value)


@dataclass(frozen=True)
class CellContext:
    """The cell that a Python parser or rule reads."""

    field_name: str
    field_label: str
    row: int | None = None
    column: int | None = None
    item_id: Any = None
    source_value: str | None = None
    source_uri: str | None = None
    user_data: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class DefaultContext:
    """The missing field that a default factory fills."""

    field_name: str
    field_label: str
    item_id: Any = None
    row: int | None = None
    column: int | None = None
    source_uri: str | None = None
    user_data: Mapping[str, Any] = field(default_factory=dict)
