"""Joins against tables that are usually, but not provably, small."""

from __future__ import annotations

import threading
from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024

_kept = threading.local()


def _held() -> list[DataFrame]:
    """The frames kept by this thread; the batches of a stream run in threads of their own."""
    if not hasattr(_kept, "frames"):
        _kept.frames = []
    return _kept.frames


def release_measured() -> None:
    """Free the frames that :func:`lookup_join` and :func:`hold` keep for the calling thread."""
    while _held():
        _held().pop().unpersist()


def hold(df: DataFrame) -> DataFrame:
    """Persist a frame that a query reads more than once, until :func:`release_measured`."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    _held().append(held)
    return held


def _width(df: DataFrame) -> Column:
    """An upper estimate of a row's size in bytes; nested values count as four times their JSON text."""
    def bytes_of(field: T.StructField) -> Column:
        kind = field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.octet_length(field.name)
        if isinstance(kind, T.VariantType):
            return F.octet_length(F.col(field.name).cast("string"))
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            # an element of eight bytes has two letters at least, a digit and a comma
            return F.octet_length(F.to_json(F.struct(field.name))) * 4
        return F.lit(0)

    parts = [F.coalesce(bytes_of(f), F.lit(0)) for f in df.schema.fields]
    return reduce(Column.__add__, parts, F.lit(16 * len(df.columns) + 32)).cast("long")


def is_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Count rows and bytes of ``df`` on the executors and compare with the bounds."""
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_width(df)), F.lit(0))).first()
    return rows <= max_rows and size <= max_bytes


def lookup_join(
    big: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left",
    max_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Join ``table`` to ``big`` without moving ``big`` when the table is small.

    The table is computed once and its size taken. Within the bounds it is
    broadcast. Beyond them both sides are shuffled on the key and adaptive
    execution cuts partitions that a large key makes too big.
    """
    table = hold(table)
    side = F.broadcast(table) if is_small(table, max_rows) else table
    return big.join(side, list(on), how)
