"""Count and crc32c of all keys and values in key order, computed in parallel.

A checksum's state is linear in the bytes (see codec.crc_raw): each task folds its stretch of rows from state 0 and
reports (place, rows, bytes, state); the stretches then meet in order, one small row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.functions import codec

CHUNK = 1 << 22  # bytes folded at once
_PART = "place long, row long, n long, bytes long, state long"


def _joined(key: pa.Array, value: pa.Array) -> bytes:
    """key, value, key, value, ... as one run of bytes; nulls are empty."""
    both = pc.binary_join_element_wise(key.fill_null(b"").cast(pa.large_binary()), value.fill_null(b"").cast(pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    both = both.combine_chunks() if isinstance(both, pa.ChunkedArray) else both
    _, offsets, data = both.buffers()
    if data is None:
        return b""
    ends = memoryview(offsets).cast("q")
    return bytes(memoryview(data)[ends[both.offset] : ends[both.offset + len(both)]])


def _fold(batches: Iterator[pa.RecordBatch], place: int | None = None) -> Iterator[pa.RecordBatch]:
    """One row a stretch of rows that are in order: the whole input, or with columns (place, row) each run of one place and following rows."""
    names = ["place", "row", "n", "bytes", "state"]
    at, first, n, size, state, held = place, 0, 0, 0, 0, []

    def flush():
        nonlocal size, state, held
        data = b"".join(held)
        if data:
            state = codec.crc_shift(state, len(data)) ^ codec.crc_raw(data)
            size += len(data)
        held = []

    def row():
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (at, first, n, size, state)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        if place is None:
            where, begin = batch.column(2)[0].as_py(), batch.column(3)[0].as_py()
            if (where, begin) != (at, first + n):
                if n:
                    flush()
                    yield row()
                at, first, n, size, state, held = where, begin, 0, 0, 0, []
        held.append(_joined(batch.column(0), batch.column(1)))
        n += batch.num_rows
        if sum(map(len, held)) >= CHUNK:
            flush()
    if n:
        flush()
        yield row()


def _combine(parts: DataFrame) -> DataFrame:
    """(n_rows, crc32c) of stretches, in order of (place, row): a few bytes a task."""

    def run(batches):
        n, state = 0, 0xFFFFFFFF
        for batch in batches:
            for rows, size, part in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                n, state = n + rows, codec.crc_shift(state, size) ^ part
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([state ^ 0xFFFFFFFF])], ["n_rows", "crc32c"])

    return parts.repartition(1).sortWithinPartitions("place", "row").mapInArrow(run, "n_rows long, crc32c long")


def ordered_checksum(live: DataFrame) -> DataFrame:
    """One row (n_rows, crc32c) of live rows (key, value: binary): one range shuffle, whose partitions are stretches."""

    def run(batches):
        return _fold(batches, TaskContext.get().partitionId())

    return _combine(live.select("key", "value").repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, _PART))


def stored_checksum(rows: DataFrame, places: DataFrame) -> DataFrame:
    """The same for rows (key, value, path, row) that lie in order in files, without a shuffle of them: path is a number that names a row's file, row its
    number there, and places (path, place) has the files in key order."""

    def run(batches):
        def cut():
            for batch in batches:  # a batch can cross from one file into the next
                path, row = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                edges = np.flatnonzero((path[1:] != path[:-1]) | (row[1:] != row[:-1] + 1)) + 1
                for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                    yield batch.slice(a, b - a)

        return _fold(cut())

    parts = rows.select("key", "value", "path", "row").mapInArrow(run, _PART)
    return _combine(parts.withColumnRenamed("place", "path").join(places, "path").select("place", "row", "n", "bytes", "state"))
