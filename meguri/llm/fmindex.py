"""An FM-index over symbol codes: wavelet-matrix ranks and sampled positions.

All searches are vectorised over many patterns or rows. Symbols are whole
numbers from 2 on; 1 separates texts and 0 ends the whole.
"""

from __future__ import annotations

import numpy as np

from meguri.llm.suffixes import ranks_by_doubling


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit of the symbol a level."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.zeros: list[np.ndarray] = []  # zeros before each place, a level each
        now = sequence
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - bit)]).astype(np.int32))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.n = len(sequence)

    def _down(self, level: int, bit: np.ndarray, at: np.ndarray) -> np.ndarray:
        zeros = self.zeros[level]
        left = zeros[at]
        return np.where(bit == 0, left, zeros[-1] + at - left)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low = np.zeros_like(at)
        for level in range(self.bits):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            low, at = self._down(level, bit, low), self._down(level, bit, at)
        return at - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at each place, how often it occurs before that place)."""
        symbol, low = np.zeros_like(at), np.zeros_like(at)
        for level in range(self.bits):
            zeros = self.zeros[level]
            bit = 1 - (zeros[at + 1] - zeros[at])
            symbol = 2 * symbol + bit
            low, at = self._down(level, bit, low), self._down(level, bit, at)
        return symbol, at - low


class FMIndex:
    """Index of one shard's symbols; ``sample`` sets every how many positions one is kept."""

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = 16):
        text = np.append(symbols.astype(np.int64), 0)
        n = len(text)
        ranks = ranks_by_doubling(text, np.full(n, n))[-1]
        order = np.empty(n, dtype=np.int64)
        order[ranks] = np.arange(n)
        self.tree = WaveletMatrix(text[order - 1], alphabet)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.sampled = order % sample == 0
        self.place = np.cumsum(self.sampled) - 1
        self.kept = order[self.sampled]
        self.n = n

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each row of ``patterns``."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, k]
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        high = np.maximum(low, high)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix, by stepping back to a sampled one."""
        out = np.zeros(len(rows), dtype=np.int64)
        live, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(live):
            done = self.sampled[at]
            out[live[done]] = self.kept[self.place[at[done]]] + steps
            live, at = live[~done], at[~done]
            symbol, rank = self.tree.access(at)
            at = self.before[symbol] + rank
            steps += 1
        return out
