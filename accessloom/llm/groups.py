"""Streams of keyed rows, sorted by key within partitions, seen as whole runs of one key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_runs(batches: Iterator[pa.RecordBatch], key: int | str = 0) -> Iterator[pa.Table]:
    """Tables of consecutive rows that never part a run of equal keys; each holds about one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[batch.num_rows - 1]
        if held and held[0].column(key)[held[0].num_rows - 1].equals(last) and keys[0].equals(last):
            held.append(batch)
            continue
        same = pc.equal(keys, last)
        start = pc.index(same, True).as_py()
        yield pa.Table.from_batches([*held, batch.slice(0, start)])
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def run_bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.diff(np.append(starts, len(keys)))


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For n members with links x[i] - y[i]: the first index of each one's component."""
    labels = np.arange(n)
    while len(x):
        new = labels.copy()
        least = np.minimum(labels[x], labels[y])
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        new = new[new]
        if np.array_equal(new, labels):
            break
        labels = new
    return labels
