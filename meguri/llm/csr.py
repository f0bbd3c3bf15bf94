"""Sparse matrices in compressed rows, put together by hand from numpy arrays."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Csr(NamedTuple):
    """Row r holds ``columns`` and ``values`` from ``starts[r]`` to ``starts[r + 1]``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``size`` numbers each."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def ranges(first: np.ndarray, last: np.ndarray, width: int) -> Csr:
    """Incidence of ranges: row r holds the columns from ``first[r]`` up to ``last[r]``."""
    sizes = last - first
    columns = spread(first, sizes)
    return Csr(np.concatenate([[0], np.cumsum(sizes)]), columns, np.ones(len(columns), dtype=np.int64), width)


def transposed(m: Csr) -> Csr:
    """Entries by column, rows ascending within each: a counting sort of the columns."""
    order = np.argsort(m.columns, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(m.columns, minlength=m.width))])
    return Csr(starts, m.rows[order], m.values[order], len(m.starts) - 1)


def product(left: Csr, right: Csr) -> Csr:
    """``left`` times ``right`` by Gustavson's rows: row r of the product gathers the rows
    of ``right`` that row r of ``left`` names, scaled, and adds up equal columns."""
    sizes = np.diff(right.starts)[left.columns]
    taken = spread(right.starts[left.columns], sizes)
    row = np.repeat(left.rows, sizes)
    column, value = right.columns[taken], np.repeat(left.values, sizes) * right.values[taken]
    key = row * right.width + column
    if len(key) and (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1]]))
    summed = np.add.reduceat(value, first) if len(first) else value
    key = key[first]
    starts = np.concatenate([[0], np.cumsum(np.bincount(key // max(1, right.width), minlength=len(left.starts) - 1))])
    return Csr(starts, key % max(1, right.width), summed, right.width)
