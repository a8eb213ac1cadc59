"""Shared storage and small helpers of the training-data operators.

Results of expensive steps are written as Parquet to the folder that all
executors share, so that a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import clear_scratch, remove, scratch, shared_dir

__all__ = ["clear_scratch", "few", "remove", "scratch", "shared_dir", "slices", "stored", "table", "temporaries", "text_of", "trained_on", "unstored"]

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_writers: dict[int, list] = {}
_open = threading.local()


@contextmanager
def _cleaning(spark: SparkSession):
    """Shuffle files go when the write that made them ends. The first of several writers sets this, the last one restores what was there."""
    with _lock:
        mine = _writers.setdefault(id(spark), [0, spark.conf.get(_CLEAN, None)])
        mine[0] += 1
        spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        with _lock:
            mine[0] -= 1
            if not mine[0]:
                del _writers[id(spark)]
                spark.conf.unset(_CLEAN) if mine[1] is None else spark.conf.set(_CLEAN, mine[1])


def stored(df: DataFrame, name: str, keep: int = 0) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    The write's own shuffle files are of no more use then, and are removed at
    once. keep says how many of the innermost blocks of temporaries it outlives.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with _cleaning(spark):
        df.write.parquet(path)
    scopes = getattr(_open, "paths", ())
    for paths in scopes[: max(0, len(scopes) - keep)]:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporaries(spark: SparkSession):
    """Tables that this thread stores within the block go at its end: for work whose result is stored outside of it."""
    if not hasattr(_open, "paths"):
        _open.paths = []
    paths: list[str] = []
    _open.paths.append(paths)
    try:
        yield
    finally:
        _open.paths.remove(paths)
        for path in paths:
            remove(spark, path)


def unstored(tables: list[DataFrame]) -> None:
    """Remove stored tables that nothing reads any more."""
    for t in tables:
        if files := t.inputFiles():
            remove(t.sparkSession, files[0].rpartition("/")[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def trained_on(doc_id: Column) -> Column:
    """True for rows whose labels may be learned: crc32 of the id's text, modulo 5, is not 0.

    A null id has no fold; such a row is never learned from.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def slices(batch: pa.RecordBatch, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of bytes of text (one row at least)."""
    size = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    start = 0
    while start < batch.num_rows:
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + most_bytes, "right")))
        yield batch.slice(start, end - start)
        start = end


def few(df: DataFrame, most_bytes: int = 32 << 20) -> DataFrame:
    """df, to be broadcast if its rows take at most most_bytes, which is measured, and joined by shuffle otherwise."""

    def width(name: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.octet_length(name)
        return F.octet_length(F.to_json(F.struct(name))) if kind.startswith(("array", "struct", "map")) else F.lit(8)

    row = sum((F.coalesce(width(n, k), F.lit(0)) for n, k in df.dtypes), F.lit(32))
    return F.broadcast(df) if (df.agg(F.sum(row.cast("long"))).head()[0] or 0) <= most_bytes else df
