"""Questions of text chunks to hash buckets, and back.

Counting things that occur in texts (words, shingles, windows) over all texts moves far fewer bytes when a task sends one packed
array for each bucket than when it sends a row for each occurrence:

1. rows are dealt to chunks by a hash; a chunk sends each bucket what it asks about, each distinct thing once (`ask`);
2. a bucket sees all chunks' questions about its part of the hash space and answers each (`answer`);
3. answers go back to their chunks, which hold the texts (`apply`).

Chunks and buckets are many and of even size: a thing that every text holds costs a bucket one entry for each chunk. All three
steps are plain Spark shuffles of a few columns; whatever is lost with an executor is computed again from the input.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gleanery.llm.frames import give_back, shuffle_partitions, text_bytes

CHUNK, BUCKET, PAYLOAD = "_chunk", "_bucket", "_payload"
#: Bytes of text for each chunk and bucket: a task holds one of them in memory at a time.
PART = 16 << 20


def pack(*parts) -> bytes:
    """Arrays and bytes as compressed bytes."""
    raw = pickle.dumps(parts, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(b: bytes) -> tuple:
    return pickle.loads(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True))


def chunked(rows: DataFrame, by: Iterable[Column | str], chunks: int) -> DataFrame:
    """`rows` dealt to chunks by a hash of `by`."""
    return rows.withColumn(CHUNK, F.pmod(F.xxhash64(*by), F.lit(chunks)).cast("int")).repartition(shuffle_partitions(rows), CHUNK)


def parts(rows: DataFrame, text: str) -> int:
    """How many chunks or buckets to use: twice the shuffle partitions, and so many that each has about PART bytes of text."""
    return max(2 * shuffle_partitions(rows), text_bytes(rows, text) // PART)


def ask(rows: DataFrame, question: Callable[[pa.Table], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Rows (chunk, bucket, payload): what each chunk asks each bucket."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table.column(CHUNK)[0].as_py()
        got = list(question(table))
        give_back()
        return pa.table({CHUNK: pa.array([chunk] * len(got), pa.int32()), BUCKET: pa.array([b for b, _ in got], pa.int32()), PAYLOAD: pa.array([x for _, x in got], pa.binary())})

    return rows.groupBy(CHUNK).applyInArrow(run, f"{CHUNK} int, {BUCKET} int, {PAYLOAD} binary")


def answer(questions: DataFrame, reply: Callable[[list[bytes]], list[bytes | None]]) -> DataFrame:
    """Rows (chunk, bucket, payload): each bucket's answers to its chunks; null answers are not sent."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(CHUNK)
        chunk = table.column(CHUNK).to_pylist()
        got = [(c, x) for c, x in zip(chunk, reply(table.column(PAYLOAD).to_pylist()), strict=True) if x is not None]
        give_back()
        bucket = table.column(BUCKET)[0].as_py()
        return pa.table({CHUNK: pa.array([c for c, _ in got], pa.int32()), BUCKET: pa.array([bucket] * len(got), pa.int32()), PAYLOAD: pa.array([x for _, x in got], pa.binary())})

    return questions.groupBy(BUCKET).applyInArrow(run, f"{CHUNK} int, {BUCKET} int, {PAYLOAD} binary")


def apply(rows: DataFrame, answers: DataFrame, use: Callable[[pa.Table, list[tuple[int, bytes]]], pa.Table], schema: StructType | str) -> DataFrame:
    """What each chunk makes of its rows and the answers to it (bucket, payload)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = use(left, list(zip(right.column(BUCKET).to_pylist(), right.column(PAYLOAD).to_pylist(), strict=True)))
        give_back()
        return out

    return rows.groupBy(CHUNK).cogroup(answers.groupBy(CHUNK)).applyInArrow(run, schema)


def starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def expand(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[0], lo[0] + 1, ... of n[0] numbers, then as much from lo[1], and so on."""
    return np.arange(int(n.sum())) + np.repeat(lo - (np.cumsum(n) - n), n)
