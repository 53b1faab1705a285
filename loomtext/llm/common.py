"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, opened by Spark's own reader so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets one of its own; on a cluster that is an error, as a
    folder of one machine isn't seen by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="loomtext-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


_WRITTEN: list[list[str]] = []


def durable(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and go on from the written rows.

    The lineage ends there, so a lost executor costs no recomputation of what came before, and
    nothing depends on storage local to an executor.
    """
    path = f"{shared_folder(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what ``durable`` wrote inside it; whatever was made of that must be written by then."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for path in _WRITTEN.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Arrow batches are taken in pieces of about so many bytes, since their Python objects take several times that.
PIECE_BYTES = 8 << 20


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that none is much over PIECE_BYTES."""
    for batch in batches:
        rows = batch.num_rows
        size = max(1, rows * PIECE_BYTES // max(1, batch.nbytes))
        if rows <= size:
            yield batch
        else:
            for a in range(0, rows, size):
                yield batch.slice(a, size)


def frugal(step: Callable) -> Callable:
    """For the functions of mapInArrow: small pieces in, and at the end a task's memory goes back to the system.

    Spark keeps Python workers for later tasks; what one task has cached would otherwise count
    against the executor while the next stage fills its own.
    """

    @functools.wraps(step)
    def run(batches: Iterator[pa.RecordBatch], *args, **kwargs) -> Iterator[pa.RecordBatch]:
        yield from step(pieces(batches), *args, **kwargs)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def labelled_sample(labels: DataFrame, bound: int, seed: int = 17) -> DataFrame:
    """At most ``bound`` label rows, drawn by a hash of the id: a bounded, repeatable draw."""
    return labels.orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), F.col("doc_id")).limit(bound)


def crc_fold(column: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def mix64(x: np.ndarray) -> np.ndarray:
    """A strong 64-bit finaliser (vectorised, wrapping arithmetic)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
