"""Vectors with integer components, packed into blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def components(column, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(usable, sizes, values): floor(scale * x) of every list, one after the other.

    A null list, and one with a null or non-finite component, is not usable; nor is one
    whose sum of squared differences to another could pass 2**63, as no long holds it.
    """
    values = column.flatten()
    size = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    x = np.asarray(values.cast(pa.float64()).fill_null(np.nan))
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(scale * x)
    ends = np.concatenate(([0], np.cumsum(size)))
    most = np.sqrt(2.0 ** 61 / np.maximum(size, 1))
    wrong = np.concatenate(([0], np.cumsum(~(np.abs(x) < np.minimum(np.repeat(most, size), 2.0 ** 31)))))
    usable = np.asarray(column.is_valid()) & (wrong[ends[1:]] == wrong[ends[:-1]])
    return usable, size, np.where(np.isfinite(x) & (np.abs(x) < 2.0 ** 31), x, 0).astype(np.int32)


def matrices(batches: Iterator[pa.RecordBatch], vector: str, scale: int, rows: int,
             dims: int | None = None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The usable rows of the batches, by length of their vectors (or of ``dims``
    components only), as (table of the other columns, matrix) of at most ``rows`` rows."""
    held: dict[int, list[tuple[pa.Table, np.ndarray]]] = {}

    def joined(parts):
        return pa.concat_tables([t for t, _ in parts]), np.concatenate([m for _, m in parts])
    for batch in batches:
        at = batch.schema.get_field_index(vector)
        usable, size, x = components(batch.column(at), scale)
        ends = np.concatenate(([0], np.cumsum(size)))
        others = pa.Table.from_batches([batch]).remove_column(at)
        for d in np.unique(size[usable]).tolist():
            if dims is not None and d != dims:
                continue
            some = np.flatnonzero(usable & (size == d))
            held.setdefault(d, []).append((others.take(pa.array(some)), x[ends[some][:, None] + np.arange(d)]))
            if sum(len(m) for _, m in held[d]) >= rows:
                table, matrix = joined(held.pop(d))
                whole = len(matrix) // rows * rows
                for lo in range(0, whole, rows):
                    yield table.slice(lo, rows), matrix[lo:lo + rows]
                if whole < len(matrix):
                    held[d] = [(table.slice(whole), matrix[whole:])]
    for parts in held.values():
        yield joined(parts)
