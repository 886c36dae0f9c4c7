"""Helpers the operators share: Arrow columns as bytes, row batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows handled at a time inside a task, whatever the size of Arrow's batches.
SLICE_ROWS = 512


def as_bytes(col: pa.Array) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    if pa.types.is_string(col.type):
        col = col.cast(pa.binary())
    elif pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    return [x or b"" for x in col.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def crc_fold(col: Column, mod: int) -> Column:
    """``crc32(value as text) mod``: the fold a labelled row belongs to."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(mod))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def added(docs: DataFrame, fields: list) -> tuple[DataFrame, object, dict[str, str]]:
    """``docs`` with positional column names, for a task that adds ``fields``.

    A column of ``docs`` may have the name of an added one; columns are
    therefore handled as ``c0, c1, ...`` and named again by the caller.
    """
    from pyspark.sql import types as T
    old = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*old.values())
    return plain, T.StructType([*plain.schema.fields, *fields]), old
