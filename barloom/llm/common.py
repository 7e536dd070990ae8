"""What the text operators share: words, whole-batch Python maps, checkpoints."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import reachable, shared_folder

#: A word is a run of anything but the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow: batches are bounded in rows and bytes, so memory doesn't follow the partition."""
    reachable(df.sparkSession)
    return df.mapInArrow(f, schema)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the cluster's shared folder (spark.checkpoint.dir)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A materialised table, sent to every task if it has at most ``most`` rows; beyond that Spark picks the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def attach(docs: DataFrame, columns: dict[str, tuple[str, pa.DataType]], f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """map_batches with the whole row in a struct column ``doc``, apart from f's own columns, so that names can't clash.

    columns: name for f, the row's column and its type; they are taken from the struct, so nothing travels twice.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    places = {name: (docs.columns.index(c), kind) for name, (c, kind) in columns.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def with_columns(b: pa.RecordBatch) -> pa.RecordBatch:
            doc = b.column("doc")
            return pa.RecordBatch.from_arrays([doc, *(doc.field(k).cast(kind) for k, kind in places.values())], names=["doc", *places])

        return f(map(with_columns, batches))

    return map_batches(rows, run, beside(rows.schema["doc"], schema))


def beside(field: T.StructField, schema: str) -> T.StructType:
    """A schema of the field and what the DDL names."""
    return T.StructType([field, *T.StructType.fromDDL(schema).fields])


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Columns without nulls that tell documents apart unless id and text are equal."""
    i, t = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return [F.coalesce(i, F.lit(0)).alias("key_id"), i.isNull().alias("key_null"), F.xxhash64(F.coalesce(t, F.lit(""))).alias("key_text")]


_state: dict = {}


def release() -> None:
    """Hands memory that a worker no longer uses back to the system, as the C library allows."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def state(key: object, make: Callable[[], object]) -> object:
    """What an operator remembers in a Python worker from task to task; another operator's memory makes way for it."""
    if key not in _state:
        forget()
        _state[key] = make()
    return _state[key]


def forget() -> None:
    """Frees what an earlier query left in a Python worker, which would stay beside what a step without such memory needs."""
    if _state:
        _state.clear()
        release()


def pieces(batch: pa.RecordBatch, most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with texts of ``most`` bytes together; a longer text stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def each_text(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The texts of a batch one by one, null as the empty text; so a batch of long texts isn't held twice."""
    return (x.as_py() or "" for x in batch.column(column))
