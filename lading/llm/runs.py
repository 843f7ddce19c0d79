"""Helpers for sorted streams of Arrow batches: whole groups at a time, pairs in blocks, and few links for many."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pairs that are held at once.
PAIRS = 2_000_000


def whole_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of batches, sorted by key, cut anew so that no group of equal keys is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in key]
        last = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cols])) if batch.num_rows > 1 else np.array([], int)
        first = bool(held) and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in key)
        if first:
            yield pa.Table.from_batches(held)
            held = []
        if len(last):
            cut = int(last[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def group_starts(cols: list[np.ndarray]) -> np.ndarray:
    """For each row the place where its group of equal neighbours starts."""
    n = len(cols[0])
    new = np.ones(n, bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.maximum.accumulate(np.where(new, np.arange(n), 0))


def ranged_pairs(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, other) for each row's range of others [low, high), about PAIRS at a time."""
    counts = np.maximum(high - low, 0)
    ends = np.cumsum(counts)
    at, n = 0, len(counts)
    while at < n:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
        c = counts[at:to]
        total = int(c.sum())
        if total:
            row = np.repeat(np.arange(at, to), c)
            yield row, np.arange(total) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[at:to], c)
        at = to


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join just what the links (a, b) join: one less than nodes for each component."""
    if not len(a):
        return a, b
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        was = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(up := root[root], root):
            root = up
        if (was == root).all():
            break
        keep = root[x] != root[y]
        x, y = x[keep], y[keep]
    own = np.arange(len(nodes)) != root
    return nodes[own], nodes[root[own]]
