"""Folds of keys in order with a small state: rows are sorted by key in their partitions and streamed through, so that a key of any size costs no memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Rows that go back to Spark at once.
OUT = 4096


def fold(
    rows: DataFrame,
    by: list[str],
    order: list[str],
    values: list[str],
    schema: str,
    start: Callable[[], Any],
    step: Callable[..., tuple[Any, tuple | None]],
    end: Callable[[Any], tuple | None] | None = None,
) -> DataFrame:
    """Rows of the keys `by` and the columns of `schema`: what `step` makes of each row in order, and `end` of a key's last state.

    `step(state, *values)` returns the next state and a row to put out, or None; `end(state)` a row or None. The state has to stay small.
    Equal rows in `order` come in any order.
    """
    slim = rows.select(*by, *[c for c in dict.fromkeys([*order, *values]) if c not in by])
    kind = StructType([*[StructField(c, slim.schema[c].dataType) for c in by], *StructType.fromDDL(schema).fields])
    arrow, n = to_arrow_schema(kind), len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(arrow)], schema=arrow)
            out.clear()
            return made

        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in by), strict=True))
            for k, *v in zip(keys, *(b.column(c).to_pylist() for c in values), strict=True):
                if k != key:
                    if key is not None and end is not None and (last := end(state)) is not None:
                        out.append((*key, *last))
                    key, state = k, start()
                state, made = step(state, *v)
                if made is not None:
                    out.append((*k, *made))
                if len(out) >= OUT:
                    yield batch()
        if key is not None and end is not None and (last := end(state)) is not None:
            out.append((*key, *last))
        if out:
            yield batch()

    return slim.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, kind)
