"""Typed, validated tables on Spark: declared schemas compiled to Catalyst expressions, records and diagnostics as frames."""

from .api import Result, lenient, parse_records, parse_table, parse_table_as, validate_table
from .checker import FeatureDiagnostic, check_feature, check_feature_tables
from .context import CellContext, DefaultContext, ParseContext
from .diagnostics import CODES, DIAGNOSTIC, Diagnostic, DiagnosticSeverity, SchemaDefinitionError, TableError, TableErrorCode, TableErrors, TableWarning, stable_json
from .fields import Field, Reference, discriminator, discriminator_field, field, id_field, reference
from .functions.cell_dsl import CellDSL, CellDSLChain, compose_cell_dsls
from .functions.parsed import Parser
from .functions.parsers import boolean, choice, compose, custom, date, datetime, decimal, each, enum, floating, identity, integer, literal, map_value, optional, split, string
from .operators.checks import aggregate, all_rows, at_least, check, unique
from .operators.groups import AlphabeticRange, ColumnGroupExpander, NumericRange, PrefixRepeat, PythonRange, PythonRepeat, RangeRule, RepeatRule, SuffixRepeat
from .operators.transforms import TableTransformer, TransformerPipeline, compose_transformers
from .introspection import FieldContract, TableContract, VariantContract
from .output import RecordSource
from .schema import ColumnTable, Fields, RowTable
from .sources.cells import CELL_SCHEMA, CellFrame, TableCell, read_tables
from .sources.features import FeatureTable, discover_feature_tables, read_feature_files, read_features

#: Other names of the same things.
ReferenceSpec, TableData, TableFields, ValidationResult = Reference, CellFrame, Fields, Result

__version__ = "0.2.0"
__all__ = sorted(n for n in dir() if not n.startswith("_"))
