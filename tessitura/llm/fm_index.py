"""An FM-index over sequences of word numbers: backward search, and occurrences by sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(keys: np.ndarray) -> np.ndarray:
    """The order of all suffixes, by prefix doubling; keys that occur once end every comparison."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    rank = np.empty(n, np.int64)
    step = 1
    ranked = keys[order]
    rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
    while n and rank[order[-1]] < n - 1:
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:] + 1
        pair = rank * (n + 1) + later
        order = np.argsort(pair)
        ranked = pair[order]
        rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        step *= 2
    return order


class WaveletMatrix:
    """rank(symbol, i) over a sequence, one bit plane per binary digit of a symbol."""

    def __init__(self, values: np.ndarray, top: int) -> None:
        self.digits = max(1, int(top).bit_length())
        self.n = len(values)
        self.planes = []
        for digit in reversed(range(self.digits)):
            bits = (values >> digit) & 1 == 1
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            small = np.packbits(bits, bitorder="little")
            packed[: len(small)] = small
            words = packed.view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            self.planes.append((digit, words, before, self.n - int(bits.sum())))
            values = np.concatenate((values[~bits], values[bits]))

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[block] + np.bitwise_count(words[block] & below)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low = np.zeros_like(at)
        for digit, words, before, zeros in self.planes:
            one = (symbol >> digit) & 1 == 1
            high_ones, low_ones = self._ones(words, before, at), self._ones(words, before, low)
            at = np.where(one, zeros + high_ones, at - high_ones)
            low = np.where(one, zeros + low_ones, low - low_ones)
        return at - low


class FMIndex:
    """Runs of positive numbers, each closed by a separator of its own, so that no match leaves a run.

    `text` holds the runs with a 0 after each. Suffix positions are kept at every `sample`-th place
    and where a run begins, so a walk from any occurrence ends within its run.
    """

    def __init__(self, text: np.ndarray, top: int, sample: int = 16) -> None:
        self.n = len(text)
        gap = text == 0
        gaps = int(gap.sum())
        keys = np.where(gap, np.cumsum(gap) - 1, text + gaps)
        suffixes = suffix_array(keys)
        self.last = text[suffixes - 1]
        if self.n:
            self.last[suffixes == 0] = 0
        counts = np.bincount(text, minlength=top + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.wavelet = WaveletMatrix(self.last, top)
        opens = np.concatenate(([True], gap[:-1])) if self.n else gap
        kept = (suffixes % sample == 0) | opens[suffixes]
        self.kept = kept
        self.kept_before = np.cumsum(kept) - kept
        self.places = suffixes[kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each phrase (rows of equal length), found from its last word to its first."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for k in reversed(range(phrases.shape[1])):
            symbol = phrases[alive, k]
            base = self.first[symbol]
            low[alive] = base + self.wavelet.rank(symbol, low[alive])
            high[alive] = base + self.wavelet.rank(symbol, high[alive])
            gone = low[alive] >= high[alive]
            high[alive[gone]] = low[alive[gone]]
            alive = alive[~gone]
            if not len(alive):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin in the text."""
        out = np.empty(len(rows), np.int64)
        todo, at = np.arange(len(rows)), rows.astype(np.int64)
        steps = 0
        while len(todo):
            done = self.kept[at]
            out[todo[done]] = self.places[self.kept_before[at[done]]] + steps
            todo, at = todo[~done], at[~done]
            symbol = self.last[at]
            at = self.first[symbol] + self.wavelet.rank(symbol, at)
            steps += 1
        return out
