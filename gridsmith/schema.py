"""Declared schemas: collected from classes, checked and compiled once, immutable afterwards."""

from __future__ import annotations

import sys
import typing
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from dataclasses import replace as dc_replace
from enum import Enum
from types import MappingProxyType
from typing import Any

from pyspark.sql import types as T

from . import annotations as A
from .diagnostics import SchemaDefinitionError
from .fields import Field, Reference
from .functions.parsed import Parser, type_of
from .functions.parsers import spark_type, to_parser

ROW, COLUMN = "row", "column"
RESERVED = frozenset(
    {"parse", "parse_as", "parse_records", "validate", "lenient", "describe", "variant", "variant_for", "variant_frame", "validate_record", "validate_records", "build_output", "transform_table", "transformer", "output_model"}
    | {"unknown_fields", "inapplicable_fields", "checks", "orientation", "as_dict", "source_for", "table_source", "table_extras", "stream"}
)


@dataclass(frozen=True)
class CompiledField:
    name: str
    label: str
    aliases: tuple[str, ...]
    required: bool
    has_default: bool
    default: Any
    default_factory: Callable | None
    parser: Parser | None
    policy: str
    is_id: bool
    is_discriminator: bool
    reference: Reference | None
    dtype: T.DataType
    annotation: Any = None

    @property
    def labels(self) -> tuple[str, ...]:
        return (self.label, *self.aliases)

    def literal(self) -> Any:
        """The default as a column literal."""
        return self.default.name if isinstance(self.default, Enum) else self.default

    def decode(self, value: Any) -> Any:
        if self.parser is not None and self.parser.decode is not None:
            return self.parser.decode(value)
        return list(value) if isinstance(value, (list, tuple)) else value


@dataclass(frozen=True)
class Plan:
    """One compiled schema, or one variant of it."""

    schema: type
    name: str
    orientation: str
    fields: Mapping[str, CompiledField]
    inapplicable: str
    transformers: tuple[Any, ...]
    checks: tuple[Any, ...]
    variants: Mapping[Any, Plan] = field(default_factory=dict)

    @property
    def id(self) -> CompiledField | None:
        return next((f for f in self.fields.values() if f.is_id), None)

    @property
    def discriminator(self) -> CompiledField | None:
        return next((f for f in self.fields.values() if f.is_discriminator), None)

    @property
    def family(self) -> tuple[Plan, ...]:
        return (self, *self.variants.values())

    def labels(self) -> list[str]:
        return list(dict.fromkeys(x for p in self.family for f in p.fields.values() for x in f.labels))

    def hook(self, name: str) -> Any:
        """The schema's own hook of that name, or None where the base class's would run."""
        own = getattr(self.schema, name, None)
        base = getattr(Table, name, None)
        return None if own is None or getattr(own, "__func__", own) is getattr(base, "__func__", base) else own


def annotation_of(cls: type, name: str) -> Any:
    """A field's annotation in the namespace of the class that declares it; None where there is none or it can't be resolved."""
    raw = cls.__dict__.get("__annotations__", {})
    if name not in raw:
        return None
    found = raw[name]
    if not isinstance(found, str):
        return found
    space = dict(vars(sys.modules.get(cls.__module__, typing)))
    try:
        return eval(found, space, {**vars(typing), **space, **{k: v for k, v in vars(cls).items() if not isinstance(v, Field)}})  # noqa: S307 - the schema author's own annotation
    except Exception:
        return None


class SchemaMeta(type):
    __fields__: dict[str, Field]

    def __new__(mcls, name: str, bases: tuple[type, ...], space: dict[str, Any]):
        own = {k: v for k, v in space.items() if isinstance(v, Field)}
        merged: dict[str, Field] = {}
        origin: dict[str, type] = {}
        for b in bases:
            for k, f in getattr(b, "__fields__", {}).items():
                if k in merged and merged[k] is not f and k not in own:
                    raise SchemaDefinitionError(f"{name} inherits two different fields named {k!r}", schema=name, field_name=k)
                merged.setdefault(k, f)
                origin.setdefault(k, b.__origins__[k])
        for k in merged:
            if k in space and k not in own:
                raise SchemaDefinitionError(f"{name}.{k} hides an inherited field", schema=name, field_name=k)
        for k, f in own.items():
            if k in RESERVED or k.startswith("_"):
                raise SchemaDefinitionError(f"{k!r} is a reserved name", schema=name, field_name=k)
            merged[k] = space[k] = f.bound(k, name)
        cls = super().__new__(mcls, name, bases, space)
        for k in own:
            origin[k] = cls
        # The binding is seen by whoever reuses the declared object.
        for k, f in own.items():
            object.__setattr__(f, "name", k)
            object.__setattr__(f, "owner", name)
        type.__setattr__(cls, "__fields__", merged)
        type.__setattr__(cls, "__origins__", origin)
        type.__setattr__(cls, "__frozen__", False)
        if not space.get("__framework__", False) and getattr(cls, "orientation", None) is not None:
            type.__setattr__(cls, "__plan__", compile_schema(cls))
            type.__setattr__(cls, "__sealed__", False)
            d = cls.__plan__.discriminator
            declared = merged[d.name].variants if d else None
            if declared and not space.get("__variant__", False) and not any(getattr(b, "__plan__", None) and b.__plan__.variants for b in bases):
                for value, part in declared.items():
                    if not (isinstance(part, type) and issubclass(part, Fields)):
                        raise TypeError(f"the variant {value!r} must be a Fields component")
                    made = SchemaMeta(f"{name}[{value}]", (part, cls) if not issubclass(part, Table) else (part,), {"__module__": cls.__module__, "__variant__": True, "__qualname__": f"{cls.__qualname__}[{value}]"})
                    register(cls, value, made)
        type.__setattr__(cls, "__frozen__", True)
        return cls

    def __setattr__(cls, name: str, value: Any) -> None:
        if cls.__dict__.get("__frozen__") and (name in cls.__fields__ or name in RESERVED or name.startswith("__") and name not in ("__doc__", "__module__", "__abstractmethods__")):
            raise AttributeError(f"{cls.__name__}.{name} is fixed once the schema is declared")
        super().__setattr__(name, value)


def compile_field(cls: type, f: Field, origin: type) -> CompiledField:
    fail = lambda text: SchemaDefinitionError(f"{cls.__name__}.{f.name}: {text}", schema=cls.__name__, field_name=f.name)
    annotation = annotation_of(origin, f.name)
    parser = to_parser(f.parser) if f.parser is not None else None
    if parser is None and f.reference is None and annotation is not None:
        parser = A.infer(annotation)
    if parser is None and f.policy == "parse":
        raise fail("empty='parse' needs a parser")
    if annotation is not None and f.reference is None:
        if not f.required and not f.has_default and f.default_factory is None and not A.admits(annotation, None):
            raise fail("a missing label gives None, which the annotation doesn't admit")
        if f.has_default and not A.admits(annotation, f.default):
            raise fail("the default isn't of the annotated type")
        if f.policy == "raw" and not A.admits(annotation, ""):
            raise fail("a blank cell stays '', which the annotation doesn't admit; use empty='none', 'parse' or 'error'")
        if f.policy == "none" and not A.admits(annotation, None):
            raise fail("empty='none' gives None, which the annotation doesn't admit")
        if parser is None and not A.admits_text(annotation):
            raise fail("text would stay text, which the annotation doesn't admit; give a parser")
    if parser is not None:
        kind = parser.dtype
    elif f.returns is not None:
        kind = type_of(f.returns)
    elif f.has_default and f.default is not None and not isinstance(f.default, (str, Enum)):
        raise fail("the default isn't text, so the field needs a parser or returns=")
    else:
        kind = T.StringType()
    if f.has_default and f.default is not None and f.reference is None and not isinstance(f.default, Enum):
        try:
            spark_type([f.default])
        except TypeError:
            raise fail("the default has no column type") from None
    return CompiledField(f.name, f.label, f.aliases, f.required, f.has_default, f.default if f.has_default else None, f.default_factory, parser, f.policy, f.is_id, f.is_discriminator, f.reference, kind, annotation)


def compile_schema(cls: type) -> Plan:
    fail = lambda text, name=None: SchemaDefinitionError(f"{cls.__name__}: {text}", schema=cls.__name__, field_name=name)
    fields = {k: compile_field(cls, f, cls.__origins__[k]) for k, f in cls.__fields__.items()}
    seen: dict[str, str] = {}
    for f in fields.values():
        for x in f.labels:
            if x in seen:
                raise fail(f"the label {x!r} belongs to {seen[x]!r} and {f.name!r}", f.name)
            seen[x] = f.name
    if cls.orientation not in (ROW, COLUMN):
        raise fail(f"orientation must be {ROW!r} or {COLUMN!r}")
    if cls.unknown_fields != "forbid":
        raise fail("unknown_fields can only be 'forbid'")
    if cls.inapplicable_fields not in ("error", "preserve"):
        raise fail("inapplicable_fields must be 'error' or 'preserve'")
    ids = [f.name for f in fields.values() if f.is_id]
    if len(ids) > 1:
        raise fail("a schema has one id field at most")
    if cls.orientation == COLUMN and len(ids) != 1:
        raise fail("a column schema needs exactly one id field")
    chosen = [f.name for f in fields.values() if f.is_discriminator]
    if len(chosen) > 1:
        raise fail("a schema has one discriminator at most")
    for f in fields.values():
        if f.reference and not chosen and f.reference.target not in fields:
            raise fail(f"the reference {f.name!r} has an undeclared target {f.reference.target!r}", f.name)
    steps = cls.transformer
    steps = () if steps is None else tuple(steps) if isinstance(steps, (list, tuple)) else (steps,)
    if not all(callable(getattr(s, "transform", None)) for s in steps):
        raise fail("a transformer needs a method transform()")
    if cls.output_model is not None and not callable(cls.output_model):
        raise fail("output_model must be callable")
    for name in ("validate_record", "validate_records", "build_output", "transform_table"):
        if not callable(getattr(cls, name)):
            raise fail(f"{name} must be callable")
    for k, f in list(fields.items()):
        if f.reference and f.reference.target in fields:
            fields[k] = with_target(f, fields[f.reference.target])
    return Plan(cls, cls.__name__, cls.orientation, MappingProxyType(fields), cls.inapplicable_fields, steps, tuple(cls.checks))


def with_target(f: CompiledField, target: CompiledField) -> CompiledField:
    """A reference with the key type of its target."""
    return dc_replace(f, dtype=T.ArrayType(target.dtype) if f.reference.many else target.dtype)


def register(root: type, value: Any, part: type) -> None:
    plan: Plan = root.__plan__
    if plan.discriminator is None:
        raise SchemaDefinitionError(f"{root.__name__}: variants need a discriminator field", schema=root.__name__)
    if root.__sealed__:
        raise SchemaDefinitionError(f"{root.__name__}: no variant can be registered after the first table", schema=root.__name__)
    hash(value)
    if value in plan.variants:
        raise ValueError(f"the variant {value!r} is already registered")
    own = part.__plan__
    if own.discriminator is None or own.discriminator.label != plan.discriminator.label:
        raise SchemaDefinitionError(f"{part.__name__} must keep the discriminator of {root.__name__}", schema=part.__name__)
    type.__setattr__(root, "__plan__", dc_replace(plan, variants=MappingProxyType({**plan.variants, value: own})))


def seal(cls: type) -> Plan:
    """The final plan of a schema family; variants are complete from here on, and references are checked across them."""
    plan: Plan = cls.__plan__
    if plan.discriminator is not None and not plan.variants:
        raise SchemaDefinitionError(f"{cls.__name__}: the discriminator has no variants", schema=cls.__name__)
    targets: dict[str, list[CompiledField]] = {}
    for p in plan.family:
        for f in p.fields.values():
            targets.setdefault(f.name, []).append(f)
    done: list[Plan] = []
    for p in plan.family:
        fields = dict(p.fields)
        for k, f in fields.items():
            if f.reference is None:
                continue
            found = targets.get(f.reference.target)
            if not found:
                raise SchemaDefinitionError(f"{p.name}.{k}: the reference has an undeclared target {f.reference.target!r}", schema=p.name, field_name=k)
            if len({id(x.parser) if x.parser is not None and cls.__fields__.get(x.name) is None else repr(x.dtype) for x in found}) > 1:
                raise SchemaDefinitionError(f"{p.name}.{k}: variants read the target {f.reference.target!r} by different parsers", schema=p.name, field_name=k)
            fields[k] = with_target(f, found[0])
        done.append(dc_replace(p, fields=MappingProxyType(fields), variants=MappingProxyType({})))
    final = dc_replace(done[0], variants=MappingProxyType(dict(zip(plan.variants, done[1:]))))
    type.__setattr__(cls, "__plan__", final)
    type.__setattr__(cls, "__sealed__", True)
    return final


class Fields(metaclass=SchemaMeta):
    """A reusable group of fields, mixed into schemas."""

    __framework__ = True
    orientation = None


class Table(Fields):
    """What row and column tables share; instances are records at the Python edge."""

    __framework__ = True
    orientation: Any = None
    unknown_fields = "forbid"
    inapplicable_fields = "error"
    transformer: Any = None
    output_model: Any = None
    checks: tuple[Any, ...] = ()

    # Hooks; a schema overrides those it needs.
    def validate_record(self, context: Any) -> None:
        """Raises for a record that isn't valid; runs in Python, in batches on the executors."""

    @classmethod
    def validate_records(cls, records: Any, context: Any) -> None:
        """Raises for a table that isn't valid; runs in Python on the driver, for tables of bounded size."""

    @classmethod
    def build_output(cls, record: Any, context: Any) -> Any:
        return record

    @classmethod
    def transform_table(cls, cells: Any, context: Any) -> Any:
        """Cells to cells, before orientation; the transformers of the schema by default."""
        from .operators.transforms import run_transformers

        return run_transformers(cls.__plan__.transformers, cells, context, cls)

    @classmethod
    def variant(cls, value: Any) -> Callable[[type], type]:
        """A decorator that registers a subclass as the schema of records with this discriminator value."""

        def add(part: type) -> type:
            if not (isinstance(part, type) and issubclass(part, cls)) or part is cls:
                raise TypeError(f"a variant must be a subclass of {cls.__name__}")
            register(cls, value, part)
            return part

        return add

    @classmethod
    def variant_for(cls, value: Any) -> type:
        return cls.__plan__.variants[value].schema

    @classmethod
    def describe(cls) -> Any:
        from .introspection import describe_schema

        return describe_schema(cls)

    @classmethod
    def lenient(cls, table: Any, **options: Any) -> Any:
        from .api import lenient

        return lenient(cls, table, **options)

    @classmethod
    def validate(cls, table: Any, **options: Any) -> Any:
        from .api import validate_table

        return validate_table(cls, table, **options)

    @classmethod
    def parse(cls, table: Any, **options: Any) -> Any:
        from .api import parse_table

        return parse_table(cls, table, **options)

    @classmethod
    def parse_records(cls, table: Any, **options: Any) -> Any:
        from .api import parse_records

        return parse_records(cls, table, **options)

    @classmethod
    def parse_as(cls, table: Any, output_model: Any = None, **options: Any) -> Any:
        from .api import parse_table_as

        return parse_table_as(cls, table, output_model, **options)

    @classmethod
    def variant_frame(cls, records: Any, value: Any) -> Any:
        """The records of one variant, with its fields only."""
        from pyspark.sql import functions as F

        plan = cls.__plan__.variants[value]
        return records.filter(F.col("_variant") == str(value)).select(*(n for n in plan.fields if n in records.columns))

    # Records.
    @classmethod
    def _of(cls, values: Mapping[str, Any], source: Any, extras: Mapping[str, str]) -> Any:
        record = cls.__new__(cls)
        record.__dict__.update(values)
        record.__dict__["_source"] = source
        record.__dict__["_extras"] = dict(extras or {})
        return record

    @property
    def table_source(self) -> Any:
        return self.__dict__["_source"]

    @property
    def table_extras(self) -> Mapping[str, str]:
        return MappingProxyType(self.__dict__["_extras"])

    def source_for(self, name: str) -> Any:
        return self.__dict__["_source"].cells[name]

    def as_dict(self) -> dict[str, Any]:
        return {k: self.__dict__[k] for k in type(self).__fields__ if k in self.__dict__}

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.as_dict() == other.as_dict()

    __hash__ = None

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.as_dict().items())})"


class RowTable(Table):
    """The first row holds labels; every other row is a record."""

    __framework__ = True
    orientation = ROW


class ColumnTable(Table):
    """The first column holds labels, the id's first; every other column is a record."""

    __framework__ = True
    orientation = COLUMN
