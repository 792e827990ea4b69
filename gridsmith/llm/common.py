"""Helpers shared by the operators: the shared folder, written tables, Arrow maps."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, a local session gets a temporary folder; a cluster must set it.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    held = getattr(shared_dir, "own", None)
    if held is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        held = tempfile.mkdtemp(prefix="gridsmith-")
        atexit.register(shutil.rmtree, held, True)
        shared_dir.own = held
    return f"file://{held}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    for held in _scopes:
        held.append(out)
    return out


_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables written inside, but for those given to what it yields; for work that is done when it ends."""
    held: list[DataFrame] = []
    kept: set[str] = set()
    _scopes.append(held)

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table.written_to)
        return table

    try:
        yield keep
    finally:
        _scopes.remove(held)
        drop_tables(*(t for t in held if t.written_to not in kept))


def drop_tables(*tables: DataFrame) -> None:
    """Deletes what write_table() wrote, once all that was made of it is written too."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def let_go(spark: SparkSession) -> None:
    """Has the driver notice which shuffles no frame needs any more: executors delete the files of those."""
    gc.collect()
    spark._jvm.System.gc()


def read_documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of doc_id as text leaves no remainder by 5; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as make it none of df's columns, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def aside(df: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """df with its columns of names that an operator uses renamed, and what gives all columns their own names again."""
    clashing = [c for c in df.columns if c.lower() in {u.lower() for u in used}]
    renamed = dict(zip(clashing, fresh(df, *(f"user_{c}" for c in clashing))))
    return df.withColumnsRenamed(renamed), [F.col(f"`{renamed.get(c, c)}`").alias(c) for c in df.columns]


def with_columns_schema(df: DataFrame, added: list[tuple[str, T.DataType]]) -> T.StructType:
    names = {n for n, _ in added}
    fields = [f for f in df.schema.fields if f.name not in names]
    return T.StructType([*fields, *(T.StructField(n, t, True) for n, t in added)])


#: Rows of an Arrow batch at most; texts are long, and each Python worker holds a batch, its bytes and what is made of them.
BATCH_ROWS = 1_024


def bound_batches(spark: SparkSession) -> None:
    """Keeps the session's Arrow batches to BATCH_ROWS rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def give_back() -> None:
    """Returns freed memory to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """run, a function over batches, that gives back memory when a task ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """run, a function over a group's table, that gives back memory behind each group."""

    def wrapped(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    return wrapped


def arrow_map(df: DataFrame, run: Callable, schema: Any) -> DataFrame:
    bound_batches(df.sparkSession)
    return df.mapInArrow(tidy(run), schema)


def map_texts(
    df: DataFrame,
    added: list[tuple[str, T.DataType]],
    make: Callable[[], Callable[[pa.RecordBatch], dict]],
) -> DataFrame:
    """df with columns computed per Arrow batch; a column of an added name is replaced.

    make() runs once per task and returns a function from a batch to {name: values}.
    """
    schema = with_columns_schema(df, added)
    arrow = to_arrow_schema(schema)
    names = {n for n, _ in added}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch):
                got = f(part)
                cols = []
                for field in arrow:
                    col = got[field.name] if field.name in names else part.column(part.schema.get_field_index(field.name))
                    if not isinstance(col, (pa.Array, pa.ChunkedArray)):
                        col = pa.array(col, type=field.type)
                    cols.append(col if col.type == field.type else col.cast(field.type))
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)

    return arrow_map(df, run, schema)


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes, one row at least."""
    rows = batch.num_rows
    step = max(1, int(rows * most / max(batch.nbytes, 1)))
    for lo in range(0, rows, step):
        yield batch.slice(lo, step)

