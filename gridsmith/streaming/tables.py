"""Schemas over streams of wide rows.

Values, empties, variants and record checks are projections, so they run unchanged on a stream. What needs to see other records,
repeated ids and references, is done within the batches of foreachBatch, or for ids within a watermark by dropDuplicatesWithinWatermark.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..api import Result, lenient
from ..diagnostics import SchemaDefinitionError
from ..schema import seal


def stateless(schema: type, stream: DataFrame, **options: Any) -> DataFrame:
    """The typed records of a stream with their diagnostics in _diag, for schemas without id and references."""
    plan = seal(schema)
    if plan.id is not None or any(f.reference for p in plan.family for f in p.fields.values()):
        raise SchemaDefinitionError("ids and references look at other records; use each_batch or unique_ids", schema=schema.__name__)
    return lenient(schema, stream, **options).all_records


def good(records: DataFrame) -> DataFrame:
    return records.filter("_ok")


def unique_ids(records: DataFrame, id_column: str, event_time: str, delay: str) -> DataFrame:
    """The first record of each id within the watermark; later ones are dropped, and state stays bounded."""
    return records.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([id_column])


def each_batch(schema: type, stream: DataFrame, sink: Any, **options: Any) -> Any:
    """A stream writer that gives sink(result: Result, batch_id) for each batch; ids and references hold within a batch."""

    def run(batch: DataFrame, number: int) -> None:
        result: Result = lenient(schema, batch, **options)
        sink(result, number)

    return stream.writeStream.foreachBatch(run)


def windowed_counts(records: DataFrame, event_time: str, window: str, delay: str) -> DataFrame:
    """Good and rejected records for each tumbling window of event time; late rows beyond the delay are left out."""
    failed = ~F.col("_ok")
    return records.withWatermark(event_time, delay).groupBy(F.window(event_time, window)).agg(F.count_if(~failed).alias("good"), F.count_if(failed).alias("rejected"))
