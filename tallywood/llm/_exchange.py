"""Questions from chunks of documents to buckets of a hash space, and the answers back.

A chunk asks about each distinct token once, however many of its documents have
it; the bucket that owns the token sees all chunks' questions about it and
answers those it concerns. So a token that a third of all rows have costs one
question for each chunk, and no group is longer than the number of chunks.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

QUESTIONS = "bucket long, chunk long, payload binary"
ANSWERS = "chunk long, payload binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one value: their lengths in bytes, then their bytes, compressed if that is shorter."""
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    data = b"".join(parts)
    small = pa.compress(data, codec="zstd", asbytes=True) if len(data) > 256 else data
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + (small if len(small) < len(data) else data)


def unpack(value: bytes, kinds: tuple) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{len(kinds)}I", value)
    data, total = memoryview(value)[4 * len(kinds) :], sum(sizes)
    if len(data) < total:
        data = pa.decompress(data, decompressed_size=total, codec="zstd", asbytes=True)
    at, out = 0, []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def gathered(table: pa.Table, kinds: tuple) -> tuple[np.ndarray, list[np.ndarray]]:
    """All payloads of a table end to end, and the row each entry of the first array came from."""
    got = [unpack(v.as_py(), kinds) for v in table.column("payload")] if table.num_rows else []
    if not got:
        return np.zeros(0, np.int64), [np.zeros(0, k) for k in kinds]
    row = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
    return row, [np.concatenate([g[i] for g in got]) for i in range(len(kinds))]


def _questions(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "chunk": pa.array([r[1] for r in rows], pa.int64()), "payload": pa.array([r[2] for r in rows], pa.binary())})


def _answers(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"chunk": pa.array([r[0] for r in rows], pa.int64()), "payload": pa.array([r[1] for r in rows], pa.binary())})


def ask(base: DataFrame, questions: Callable[[pa.Table], list[tuple[int, bytes]]]) -> DataFrame:
    """``questions`` gets a chunk and returns (bucket, payload) pairs."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        return _questions([(b, chunk, p) for b, p in questions(table)])

    return base.groupBy("chunk").applyInArrow(run, QUESTIONS)


def ask_again(base: DataFrame, answers: DataFrame, questions: Callable[[pa.Table, pa.Table], list[tuple[int, bytes]]]) -> DataFrame:
    """As ``ask``, with the answers that each chunk got before."""

    def run(table: pa.Table, got: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _questions([])
        chunk = table.column("chunk")[0].as_py()
        return _questions([(b, chunk, p) for b, p in questions(table, got)])

    return base.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, QUESTIONS)


def answer(asked: DataFrame, answers: Callable[[pa.Table], list[tuple[int, bytes]]]) -> DataFrame:
    """``answers`` gets all questions to a bucket and returns (chunk, payload) pairs."""
    return asked.groupBy("bucket").applyInArrow(lambda table: _answers(answers(table)), ANSWERS)


def finish(base: DataFrame, answers: DataFrame, rows: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """The result of each chunk, given the answers to it."""
    return base.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(rows, schema)
