"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import uuid
import warnings
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shipping import ship

#: Maps a UTF-8 byte to itself if it belongs to a word (0-9, a-z, bytes of non-ASCII
#: characters), to lower case for A-Z, and to a space otherwise.
WORD_TABLE = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """The lower-cased words of a text; none for null."""
    return text.translate(WORD_TABLE).split() if text else []


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return as_bytes(batch.column(batch.schema.get_field_index(name)))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string array as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset on a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not named:
        named = context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = f"file:///tmp/checkpoints/brookloom-{uuid.uuid4().hex}"
        context.setCheckpointDir(named)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is left of it goes when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    return path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete paths of the shared folder."""
    for path in paths:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the context may have ended; the folder is the cluster's to clean
            return


def cut(df: DataFrame, tag: str, **options: int) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: its lineage ends there and survives lost executors.  options: of the writer."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession) -> None:
    """Shuffle files of finished steps go when the driver's JVM collects its garbage: have it do so."""
    gc.collect()
    spark._jvm.System.gc()


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, giving freed memory back to the system when a task ends: Python workers live on after their tasks."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def release() -> None:
    """Give what is free in this process back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def add_columns(
    df: DataFrame, fields: list[T.StructField], compute: Callable[[Iterator[pa.RecordBatch]], Iterable[list]], reads: list[str], keep: list[str] | None = None
) -> DataFrame:
    """Rows of df with more columns, computed batch by batch in Python and without a shuffle.

    compute gets an iterator of batches and yields, for each, a list of column values in the
    order of fields.  An input column that has the name of a new one is replaced.
    keep: the input columns to return (all, if None).
    """
    ship(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    sent = kept + [c for c in reads if c not in kept]
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])
    types = [arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tee() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in bounded(batch):
                    held.append(part)
                    yield part

        for values in compute(tee()):
            batch = held.pop(0)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            arrays += [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v, type=t) for v, t in zip(values, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(f.name for f in fields)])

    return df.select(*(F.col(f"`{c}`") for c in sent)).mapInArrow(tidied(run), schema)


def bounded(batch: pa.RecordBatch, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most` bytes, so that long texts don't add up in a Python worker."""
    if batch.num_rows == 0:
        return
    step = max(1, int(batch.num_rows * most / max(most, batch.nbytes)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def state_udf(compute: Callable[[Iterator[list[pa.Array]]], Iterator], kind: T.DataType, *columns: Column) -> Column:
    """A column computed batch by batch in Python from some others; the rest of a row stays in the JVM.

    compute gets an iterator of slices (a list of arrays, one for each column) in the order of the rows of
    a partition and yields the new values of each, so it may carry state from one to the next.  The
    column is never moved across filters by the optimizer.
    """
    arrow = arrow_type(kind)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        parts: list[int] = []

        def slices() -> Iterator[list[pa.Array]]:
            for arrays in batches:
                if isinstance(arrays, pa.Array):
                    arrays = (arrays,)
                batch = pa.RecordBatch.from_arrays(list(arrays), names=[str(k) for k in range(len(arrays))])
                own = list(bounded(batch, 1 << 20)) or [batch]
                parts.append(len(own))
                for part in own:
                    yield part.columns

        found: list[pa.Array] = []
        for values in compute(slices()):
            found.append(values if isinstance(values, pa.Array) else pa.array(values, type=arrow))
            if parts and len(found) == parts[0]:
                yield pa.concat_arrays(found)
                parts.pop(0)
                found = []

    from pyspark.sql.functions import ArrowUDFType

    with warnings.catch_warnings():
        warnings.simplefilter("ignore", UserWarning)  # of hints that one column and several would need in two forms
        udf = F.arrow_udf(tidied(run), kind, ArrowUDFType.SCALAR_ITER)
    return udf.asNondeterministic()(*columns)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label may be learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
