"""Sorted Arrow batches as groups of equal keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches, names, most: int | None = None, mark: str | None = None) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by names as (table, cuts): group k is rows cuts[k] to cuts[k + 1]; a group may span batches.

    A group of more than ``most`` rows comes in pieces; a piece starts with the last row of the one before, with ``mark`` 1.
    """
    held: list[pa.RecordBatch] = []

    def cut():
        table = pa.Table.from_batches(held)
        keys = np.stack([table[n].to_numpy() for n in names], axis=1)
        return table, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table, cuts = cut()
        if len(cuts):
            yield table.slice(0, int(cuts[-1])), np.concatenate([[0], cuts])
            held = table.slice(int(cuts[-1])).combine_chunks().to_batches()
        elif most is not None and table.num_rows > most:
            yield table, np.array([0, table.num_rows])
            last = table.slice(table.num_rows - 1)
            place = last.schema.get_field_index(mark)
            held = last.set_column(place, last.schema.field(place), pa.array([1], last.schema.field(place).type)).combine_chunks().to_batches()
    if held:
        table, cuts = cut()
        yield table, np.concatenate([[0], cuts, [table.num_rows]])
