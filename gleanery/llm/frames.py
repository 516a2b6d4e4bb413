"""Small helpers on DataFrames and in their tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from gleanery.sources.folders import checkpoint_folder, discard, stored

__all__ = ["checkpoint_folder", "discard", "give_back", "kept", "masked", "schema_with", "shuffle_partitions", "small", "stored", "text_bytes"]


def schema_with(df: DataFrame, **more: str) -> StructType:
    """The schema of `df` and further nullable columns, given as name=type."""
    return StructType([*df.schema.fields, *(StructField(k, DataType.fromDDL(v)) for k, v in more.items())])


def masked(df: DataFrame, *names: str, **more: Column) -> tuple[DataFrame, list[str], Callable[..., DataFrame]]:
    """`df` under names of its own, so that no column of the caller's can clash with those an operator adds.

    Returns the frame with columns c0, c1, ... and those of `more`, computed from the caller's; the new names of `names`; and a function
    that gives a frame's columns their old names back, followed by results: new name=column.
    """
    old = df.columns
    new = [f"c{k}" for k in range(len(old))]

    def back(out: DataFrame, **results: Column | str) -> DataFrame:
        kept = [F.col(n).alias(o) for n, o in zip(new, old, strict=True) if o not in results]
        return out.select(*kept, *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in results.items()])

    return df.select("*", *more.values()).toDF(*new, *more), [new[old.index(n)] for n in names], back


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, *columns: str) -> int:
    """Bytes in the given text or binary columns, by a scan of these columns alone: Spark's own estimates multiply at joins."""
    size = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)).cast("long") for c in columns), F.lit(0).cast("long"))
    return df.agg(F.sum(size)).first()[0] or 0


# in tasks: Python workers outlive them

#: Bytes of text in a batch that goes back to Spark.
OUT = 4 << 20
_KEPT: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What `make` returns, kept for the worker's next tasks with the same key; a worker keeps one thing at a time."""
    if key not in _KEPT:
        give_back()
        _KEPT[key] = make()
    return _KEPT[key]


def give_back() -> None:
    """Drops what the worker keeps and hands freed memory back to the system."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def small(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about OUT bytes in the column `text` each; a longer text stands alone."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + OUT, "right")))
            yield b.slice(i, j - i)
            i = j
