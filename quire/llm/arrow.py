"""Small helpers for functions that run over Arrow batches in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def out_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: pa.array(columns[f.name], f.type) for f in schema}, schema=schema)


def batched(rows: Iterator[tuple], schema: pa.Schema, max_rows: int = 2000, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of tuples, cut by rows and by the bytes of their strings and binaries."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= max_rows or size >= max_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def rows_of(batch: pa.RecordBatch, *names: str, step: int = 256) -> Iterator[tuple]:
    """The rows of a batch, with Python objects for a few rows at a time."""
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names))
