"""Sorted rows in Arrow batches, cut into groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where the groups of equal keys begin, and the end."""
    change = np.zeros(len(table), bool)
    change[:1] = True
    for k in keys:
        c = table[k].to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), len(table))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and where these begin, from rows sorted by the keys, across batches."""
    held: list[pa.RecordBatch] = []  # the last group may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.RecordBatch.from_arrays(batch.columns, batch.schema.names))  # alike in what may be null
        key = [batch.column(k)[0] for k in keys]
        if len(held) > 1 and all(batch.column(k)[batch.num_rows - 1] == key[i] == held[0].column(k)[held[0].num_rows - 1] for i, k in enumerate(keys)):
            continue  # the group goes on through all of the batch
        table = pa.Table.from_batches(held).combine_chunks()
        starts = group_starts(table, keys)
        cut = int(starts[-2])
        if cut:
            yield table.slice(0, cut), starts[:-1]
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, group_starts(table, keys)
