"""Helpers that several operators share: durable tables and columns computed per Arrow batch."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltlens.session import shared_folder

#: Texts of this many bytes together are handled at once inside an Arrow batch.
CHUNK_BYTES = 8 << 20
#: Bytes of an Arrow batch, about: batches of 10,000 rows, the default, take some 30 MB on both sides of the pipe.
BATCH_BYTES = 4 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet below the shared folder of the session and read back.

    This cuts the lineage: a lost executor loses nothing of it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/voltlens-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session from now on end at ``BATCH_BYTES``, so what a task holds outside the heap does not follow the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def discard(df: DataFrame) -> None:
    """Delete a table made by ``stored``; nothing that still reads it may run later."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.getName().startswith("voltlens-"):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear_up(spark: SparkSession) -> None:
    """Let the driver collect its garbage between the steps of a long operator.

    Only then does Spark drop the shuffles and broadcasts of finished queries, and the driver's heap, which otherwise
    grows with the number of queries planned, shrinks to what is in use.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_key(text: Column) -> list[Column]:
    """Two independent hashes of a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("voltlens"), text).alias("k2")]


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def add_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: Sequence[T.StructField],
    start: Callable[[], Callable[..., list[Sequence]]],
    keep: Sequence[str] | None = None,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Append columns computed from ``inputs`` in Arrow batches, in one narrow stage.

    ``start`` runs once per task and returns the function for a chunk: it gets one list per input
    column (texts as ``bytes``, missing values as ``None``) and returns one sequence per field.
    Columns of ``df`` with the name of a new field are replaced; ``keep`` names the columns that
    stay (default: all).  A column that is read and stays travels once.
    """
    small_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    stay = [
        f for f in df.schema.fields
        if f.name.lower() not in new and (keep is None or f.name in keep)
    ]
    kept_at = {f.name: i for i, f in enumerate(stay)}
    fresh = [c for c in dict.fromkeys(inputs) if c not in kept_at]
    sources = [kept_at[c] if c in kept_at else len(stay) + fresh.index(c) for c in inputs]
    slim = df.select(
        *(df[f.name].alias(f"keep{i}") for i, f in enumerate(stay)), *(df[c].alias(f"in{i}") for i, c in enumerate(fresh))
    )
    kinds = [arrow_type(f.dataType) for f in fields]
    names = [f"keep{i}" for i in range(len(stay))] + [f"new{i}" for i in range(len(fields))]
    out = T.StructType(
        [T.StructField(f"keep{i}", f.dataType, True) for i, f in enumerate(stay)]
        + [T.StructField(f"new{i}", f.dataType, True) for i, f in enumerate(fields)]
    )

    def run(batches):
        try:
            yield from computed(batches, start())
        finally:
            give_back()

    def computed(batches, work):
        for batch in batches:
            for part in chunks(batch, sources, chunk_bytes):
                columns = [as_bytes(part.column(i)).to_pylist() for i in sources]
                made = [pa.array(v, kind) for v, kind in zip(work(*columns), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in range(len(stay))] + made, names=names
                )

    done = slim.mapInArrow(run, out)
    return done.select(
        *(done[f"keep{i}"].alias(f.name) for i, f in enumerate(stay)),
        *(done[f"new{i}"].alias(f.name) for i, f in enumerate(fields)),
    )


def give_back() -> None:
    """Hand freed memory of a Python worker back to the system, since workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def as_bytes(column: pa.Array) -> pa.Array:
    """Texts as bytes, other columns as they are."""
    if pa.types.is_string(column.type):
        return column.cast(pa.binary())
    return column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column


def chunks(batch: pa.RecordBatch, inputs: Sequence[int], limit: int = CHUNK_BYTES):
    """Slices of a batch whose input columns stay near ``limit`` bytes (one row at least)."""
    rows, at = batch.num_rows, 0
    while at < rows:
        weight = sum(batch.column(i).slice(at).nbytes for i in set(inputs))
        step = max(1, min(rows - at, (rows - at) * limit // max(1, weight)))
        while step > 1 and sum(batch.column(i).slice(at, step).nbytes for i in set(inputs)) > 2 * limit:
            step //= 2
        yield batch.slice(at, step)
        at += step


def plain_names(docs: DataFrame, **named: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns c0, c1, ... that clash with nothing, but the ``named`` ones, and the columns that turn
    such names back."""
    own = {column: name for name, column in named.items()}
    names = [own.get(c, f"c{i}") for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]
