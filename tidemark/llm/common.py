"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch

#: Texts are handed to numpy in slices of about this many bytes, whatever the Arrow batch holds.
SLICE_BYTES = 2 << 20


#: With this setting Spark removes the shuffle files of a query when it ends; a checkpoint doesn't need them any more.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that spark.checkpoint.dir names; the shuffle files behind it are let go.

    Where that setting is unset, as in local tests, a folder of this machine is used; on a cluster that is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or scratch(spark, "checkpoint"))
    was = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a frame made under the setting
    finally:
        if was is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, was)


def total_bytes(df: DataFrame, col: str) -> int:
    return df.agg(F.sum(F.octet_length(F.col(col)))).first()[0] or 0


def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its task and waits beside the next ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows picked by a hash of the key, or all if there are no more: no task sends more than its share."""
    n = df.count()
    return df if n <= most else df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int((1 << 30) * most / n))


def byte_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes b''."""
    if not pa.types.is_binary(column.type):
        column = column.cast(pa.binary())
    return [b or b"" for b in column.to_pylist()]


def slices(batch: pa.RecordBatch, col: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices that hold about `most` bytes of text each, at least a row."""
    size = batch.column(col).cast(pa.binary()) if not pa.types.is_binary(batch.column(col).type) else batch.column(col)
    lengths = np.array([0 if n is None else n for n in pa.compute.binary_length(size).to_pylist()], np.int64)
    part = np.cumsum(lengths) // most
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else []
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def extend(docs: DataFrame, col: str, adds: dict[str, str], fn: Callable[[pa.RecordBatch], list[pa.Array]], keep: list[str] | None = None, most: int = SLICE_BYTES, after: Callable[[], None] | None = None) -> DataFrame:
    """`docs` with the columns `adds` (name: SQL type) that fn makes of each slice of rows.

    keep: the columns that stay (all of them by default); a column of docs that bears an added name is replaced.
    after: called when a task ends, to let go of what it remembers; Python workers outlive their tasks.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in adds]
    asked = docs.select(*keep, *([] if col in keep else [col]))
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"`{c}` {t}" for c, t in adds.items())])
    names = [*keep, *adds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, col, most):
                made = fn(part)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=names)
        if after is not None:
            after()
        release()

    return asked.mapInArrow(run, schema)
