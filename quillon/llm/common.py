"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a worker turns into Python objects at once.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_of(ddl: str | T.StructType) -> T.StructType:
    return ddl if isinstance(ddl, T.StructType) else T._parse_datatype_string(ddl)


def give_back() -> None:
    """Returns to the system what Arrow and the allocator keep of freed memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def returning(run: Callable) -> Callable:
    """A function of batches that gives memory back when its task ends: a worker lives on, beside those of other tasks."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def map_columns(
    df: DataFrame,
    columns: Sequence[str | Column],
    make: Callable[[], Callable[..., Sequence[Sequence]]],
    ddl: str,
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """Runs a function of Python lists over slices of the chosen columns.

    ``make`` is called once a task and returns the function; the function takes one
    list a column and returns one list (or array) an output column. Lists of the
    output may be longer or shorter than those of the input. Whole Arrow batches are
    never turned into Python objects at once, so memory follows ``rows``.
    """
    schema = schema_of(ddl)
    arrow = to_arrow_schema(schema)

    @returning
    def run(batches):
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = work(*(part.column(i).to_pylist() for i in range(part.num_columns)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, field.type) for x, field in zip(out, arrow, strict=True)], schema=arrow
                )

    return df.select(*columns).mapInArrow(run, schema)


def filter_rows(df: DataFrame, column: str, make: Callable[[], Callable[[Sequence], Sequence[bool]]], rows: int = SLICE_ROWS) -> DataFrame:
    """The rows for whose value in a column a function of lists says true; all columns pass as they are."""

    @returning
    def run(batches):
        keep = make()
        for batch in batches:
            at = batch.schema.get_field_index(column)
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def held_out(column: str, folds: int, fold: int) -> Column:
    """True where crc32 of the id as text has the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Reads the folder the cluster names; a folder of this machine only where the whole of Spark is on it, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or "/tmp/checkpoints")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a table in the shared folder, which survives a lost executor.

    A table, because its size is known: a checkpoint keeps the size that was guessed
    for its plan, a product over all joins, and over the rounds of an iteration that
    number grows until planning takes longer than the work.
    """
    return written(df, "cut")


def written(df: DataFrame, kind: str = "stage") -> DataFrame:
    """The rows as Parquet in the shared folder, read again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the folder of rows from ``written``, once nothing reads them any more."""
    spark = df.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith(("stage-", "cut-")):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
