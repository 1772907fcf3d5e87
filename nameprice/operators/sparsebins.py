"""Binned rows of which most columns hold the value 0: only the other bins are kept.

What `boosting` needs of a matrix of bins: the bin at given rows and columns, the bins that occur
in a column, and counts of rows and residuals by node and bin. Counting passes over the entries
alone; what a node's rows leave over in a column lies in its bin of zero.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

CHUNK = 1 << 22            # entries worked on at once


@dataclass(frozen=True)
class SparseBins:
    start: np.ndarray      # where each row's entries begin, and the end
    place: np.ndarray      # column of an entry, ascending in a row
    bin: np.ndarray
    zero: np.ndarray       # by column: bin of the rows without an entry

    def __len__(self) -> int:
        return len(self.start) - 1

    @cached_property
    def key(self) -> np.ndarray:
        row = np.repeat(np.arange(len(self), dtype=np.int64), np.diff(self.start))
        return row * len(self.zero) + self.place

    def at(self, rows: np.ndarray, columns) -> np.ndarray:
        """Bins at (rows[i], columns[i])."""
        zero = np.broadcast_to(self.zero[columns], len(rows))
        if not len(self.place):
            return zero
        wanted = rows * len(self.zero) + columns
        found = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        return np.where(self.key[found] == wanted, self.bin[found], zero)

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest bin of every column."""
        width = len(self.zero)
        full = np.bincount(self.place, minlength=width) == len(self)
        low, high = np.where(full, 255, self.zero).astype(np.uint8), np.where(full, 0, self.zero).astype(np.uint8)
        np.minimum.at(low, self.place, self.bin)
        np.maximum.at(high, self.place, self.bin)
        return low, high

    def cells(self, rows: np.ndarray, slot: np.ndarray, nodes: int, residual: np.ndarray,
              columns: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """boosting._cells: (nodes x 2 x cells) numbers and residual sums by node and bin."""
        total = int(ends[-1])
        base = np.full(len(self.zero), -1, dtype=np.int64)
        base[columns] = ends[:-1]
        out = np.zeros((nodes, 2, total))
        sizes = np.diff(self.start)[rows]
        before = np.cumsum(sizes) - sizes
        cuts = np.searchsorted(before, np.arange(0, int(sizes.sum()) + 1, CHUNK)) if len(rows) else np.zeros(1, np.int64)
        for a, b in zip(cuts, [*cuts[1:], len(rows)]):
            m = sizes[a:b]
            if not m.sum():
                continue
            at = np.repeat(self.start[rows[a:b]] - (before[a:b] - before[a]), m) + np.arange(m.sum())
            cell, of = base[self.place[at]], np.repeat(np.arange(a, b), m)
            kept = cell >= 0
            cell = (cell + self.bin[at] + slot[of] * total)[kept]
            out[:, 0] += np.bincount(cell, None, nodes * total).reshape(nodes, total)
            out[:, 1] += np.bincount(cell, residual[of][kept], nodes * total).reshape(nodes, total)
        whole = np.stack([np.bincount(slot, None, nodes), np.bincount(slot, residual, nodes)], axis=1)
        out[:, :, ends[:-1] + self.zero[columns]] += whole[:, :, None] - np.add.reduceat(out, ends[:-1], axis=2)
        return out


def binned(start: np.ndarray, place: np.ndarray, value: np.ndarray, edges: list[np.ndarray],
           zero: np.ndarray) -> SparseBins:
    """Bins of rows in compressed form: 0 for a missing value, else 1 + the number of edges below it."""
    found = np.zeros(len(value), dtype=np.uint8)
    order = np.argsort(place, kind="stable")
    columns, first = np.unique(place[order], return_index=True)
    for c, a, b in zip(columns.tolist(), first, [*first[1:], len(order)]):
        own = order[a:b]
        found[own] = np.where(np.isnan(value[own]), 0, 1 + np.searchsorted(edges[c], value[own], "left"))
    kept = found != zero[place]
    ends = np.append(0, np.cumsum(kept))[start]
    return SparseBins(ends, place[kept].astype(np.int32), found[kept], zero)


def zero_bins(edges: list[np.ndarray]) -> np.ndarray:
    return np.array([1 + np.searchsorted(e, 0.0, "left") for e in edges], dtype=np.uint8)


def merged(parts: list[SparseBins]) -> SparseBins:
    """The rows of all parts in order."""
    before = np.cumsum([0, *(p.start[-1] for p in parts[:-1])])
    start = np.concatenate([[0], *(p.start[1:] + b for p, b in zip(parts, before))])
    return SparseBins(start, np.concatenate([p.place for p in parts]), np.concatenate([p.bin for p in parts]), parts[0].zero)
