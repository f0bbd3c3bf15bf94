"""Suffix arrays over word codes, in numpy."""

from __future__ import annotations

import numpy as np


def ranks_by_doubling(first: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols.

    ``first`` orders single symbols, ``ends`` is the end of the text that each
    position lies in; a suffix stops there, and stopping sorts first. A rank is
    the place of the first suffix of its group, so equal ranks mean equal
    prefixes, and the last array has all suffixes of a text apart. Each round
    sorts only suffixes that are still tied.
    """
    n = len(first)
    order = np.argsort(first, kind="stable")
    rank, tied = _placed(first[order], order, np.arange(n))
    now = np.empty(n, dtype=np.int64)
    now[order] = rank
    levels, h = [now], 1
    open_ = order[tied]
    while len(open_):
        after = open_ + h
        inside = after < ends[open_]
        second = np.where(inside, now[np.where(inside, after, 0)] + 1, 0)
        order = np.lexsort((second, now[open_]))
        at = open_[order]
        key_a, key_b = now[at], second[order]
        head = np.empty(len(at), dtype=bool)
        head[0], head[1:] = True, (key_a[1:] != key_a[:-1])
        place = key_a + np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        split = head.copy()
        split[1:] |= key_b[1:] != key_b[:-1]
        group = np.maximum.accumulate(np.where(split, np.arange(len(at)), 0))
        following = now.copy()
        following[at] = place[group]
        levels.append(following)
        now, h = following, 2 * h
        last = np.append(split[1:], True)
        open_ = at[~(split & last)]
    return levels


def _placed(keys: np.ndarray, order: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return places, np.zeros(0, dtype=bool)
    split = np.empty(len(keys), dtype=bool)
    split[0], split[1:] = True, keys[1:] != keys[:-1]
    return places[np.maximum.accumulate(np.where(split, places, 0))], ~(split & np.append(split[1:], True))


def common_prefix(levels: list[np.ndarray], ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of suffixes ``a`` and ``b`` of one text each."""
    out = np.zeros(len(a), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + out, b + out
        whole = (x + (1 << k) <= ends[a]) & (y + (1 << k) <= ends[b])
        x, y = np.where(whole, x, 0), np.where(whole, y, 0)
        out += np.where(whole & (levels[k][x] == levels[k][y]), 1 << k, 0)
    return out


def longest_repeats(starts: np.ndarray, codes: np.ndarray, least: int) -> np.ndarray:
    """For each position, the length of the longest word sequence that begins
    there and begins elsewhere in the same text too; 0 where it is under ``least``.

    Neighbours in the suffix array share the longest prefixes: the greater of a
    suffix's two neighbouring values is that of the deepest interval of common
    prefixes it lies in, which is its longest repeat.
    """
    n = len(codes)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.repeat(starts[1:], sizes)
    levels = ranks_by_doubling(owner * np.int64(codes.max() + 1) + codes, ends)
    coarse = levels[min(len(levels) - 1, max(0, least.bit_length() - 1))]  # equal for 2^k <= least words
    count = np.bincount(coarse, minlength=n)
    at = np.flatnonzero(count[coarse] > 1)
    if len(levels[0]) and len(at):
        at = at[np.argsort(levels[-1][at], kind="stable")]
        pair = np.flatnonzero(coarse[at[1:]] == coarse[at[:-1]])
        a, b = at[pair], at[pair + 1]
        shared = common_prefix(levels, ends, a, b)
        shared[shared < least] = 0
        np.maximum.at(out, a, shared)
        np.maximum.at(out, b, shared)
    return out


def covered(lengths: np.ndarray) -> np.ndarray:
    """Which positions lie in the union of [i, i + lengths[i])."""
    n = len(lengths)
    reach = np.maximum.accumulate(np.where(lengths > 0, np.arange(n) + lengths, 0)) if n else lengths
    return reach > np.arange(n)
