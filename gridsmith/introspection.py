"""Schemas described as plain data."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame

from .diagnostics import stable_json
from .schema import CompiledField, Plan


@dataclass(frozen=True)
class FieldContract:
    name: str
    label: str
    aliases: tuple[str, ...]
    required: bool
    has_default: bool
    default: Any
    has_default_factory: bool
    parser: str | None
    empty: str
    is_id: bool
    is_discriminator: bool
    type: str
    native: bool
    reference_target: str | None
    reference_many: bool
    reference_separator: str | None

    @classmethod
    def of(cls, f: CompiledField) -> FieldContract:
        r = f.reference
        return cls(
            name=f.name,
            label=f.label,
            aliases=f.aliases,
            required=f.required,
            has_default=f.has_default,
            default=stable_json(f.default),
            has_default_factory=f.default_factory is not None,
            parser=(f.parser.description or f.parser.name) if f.parser else None,
            empty=f.policy,
            is_id=f.is_id,
            is_discriminator=f.is_discriminator,
            type=f.dtype.simpleString(),
            native=f.parser is None or f.parser.native,
            reference_target=r.target if r else None,
            reference_many=bool(r and r.many),
            reference_separator=r.separator if r and r.many else None,
        )


@dataclass(frozen=True)
class VariantContract:
    value: Any
    schema: str
    fields: tuple[FieldContract, ...]


@dataclass(frozen=True)
class TableContract:
    schema: str
    orientation: str
    unknown_fields: str
    inapplicable_fields: str
    fields: tuple[FieldContract, ...]
    variants: tuple[VariantContract, ...]
    transformers: tuple[str, ...]
    output_model: str | None
    hooks: tuple[str, ...]
    checks: tuple[str, ...]

    def as_dict(self) -> dict[str, Any]:
        return stable_json(asdict(self))

    def to_frame(self, spark: Any) -> DataFrame:
        """One row for each field of the schema and of its variants."""
        rows = [(self.schema, None, i, *asdict(f).values()) for i, f in enumerate(self.fields)]
        rows += [(v.schema, str(v.value), i, *asdict(f).values()) for v in self.variants for i, f in enumerate(v.fields)]
        rows = [(*r[:8], None if r[8] is None else str(r[8]), *r[9:]) for r in rows]
        kinds = "schema string, variant string, place int, name string, label string, aliases array<string>, required boolean, has_default boolean, default string, has_default_factory boolean, parser string, empty string, is_id boolean, is_discriminator boolean, type string, native boolean, reference_target string, reference_many boolean, reference_separator string"
        fixed = [(*r[:5], list(r[5]), *r[6:8], None if r[8] is None else str(r[8]), *r[9:]) for r in rows]
        return spark.createDataFrame(fixed, kinds)


def describe_schema(schema: type) -> TableContract:
    """The contract of a schema as it is now; variants may still be registered afterwards."""
    plan: Plan = schema.__plan__
    model = schema.output_model
    return TableContract(
        plan.name,
        plan.orientation,
        schema.unknown_fields,
        plan.inapplicable,
        tuple(map(FieldContract.of, plan.fields.values())),
        tuple(VariantContract(stable_json(v), p.name, tuple(map(FieldContract.of, p.fields.values()))) for v, p in plan.variants.items()),
        tuple(type(t).__name__ for t in plan.transformers),
        getattr(model, "__qualname__", type(model).__qualname__) if model is not None else None,
        tuple(h for h in ("transform_table", "validate_record", "validate_records", "build_output") if plan.hook(h)),
        tuple(type(c).__name__ for c in plan.checks),
    )
