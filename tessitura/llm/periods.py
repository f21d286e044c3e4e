"""Stretches of words that repeat with a period, found by internal pattern matching.

The words of some documents, made different from each other's, form one sequence. Its dyadic blocks are ranked by
doubling, which yields the suffix array, the interval of each block in it, and common extensions of two places
in logarithmic time. A run of period q and at least three periods holds an aligned block of the power of two in
(q/2, q] whose copy q words on lies in the run too. So each block that occurs elsewhere asks a wavelet matrix
over the suffix array for its occurrences 1 to 2 block lengths on (range successor). They form one progression:

* one or two occurrences: their distances are the candidate periods;
* three or more: block and occurrences lie in stretches whose period is the progression's difference. Unless it is
  the same stretch, only the distances of the two left ends and of the two right ends can be periods.

Runs shorter than the least block's periods come from blocks of one fixed small length and all their near
occurrences. A candidate is extended both ways, which decides it; of equal stretches the least period counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.wordhash import slices


class Blocks:
    """Ranks of all blocks of a power of two in a sequence that ends in a value of its own.

    The blocks of one rank are one interval of the suffix array that begins at the rank. Only blocks that occur
    twice are ranked further.
    """

    def __init__(self, values: np.ndarray) -> None:
        count = np.bincount(values)
        self.ranks = [(np.cumsum(count) - count)[values]]
        live = np.flatnonzero(count[values] > 1)
        self.live = [live]
        while len(live):
            rank, step = self.ranks[-1], 1 << (len(self.ranks) - 1)
            # A block that occurs twice does not reach the end: its last value is its own.
            first, second = rank[live], rank[np.minimum(live + step, len(values) - 1)]
            order = np.lexsort((second, first))
            first, second = first[order], second[order]
            at = np.arange(len(order))
            group = np.ones(len(order), bool)
            group[1:] = first[1:] != first[:-1]
            part = group.copy()
            part[1:] |= second[1:] != second[:-1]
            opens = np.maximum.accumulate(np.where(part, at, 0))
            new = rank.copy()
            new[live[order]] = first + opens - np.maximum.accumulate(np.where(group, at, 0))
            alone = part & np.append(part[1:], True)
            live = np.sort(live[order[~alone]])
            self.ranks.append(new)
            self.live.append(live)

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many values from a on equal those from b on; a < b."""
        return self._extend(a, b, 1)

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many values before a equal those before b."""
        return self._extend(a, b, -1)

    def _extend(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        done = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.ranks))):
            rank, step = self.ranks[k], 1 << k
            x, y = (a + done, b + done) if way > 0 else (a - done - step, b - done - step)
            same = (x >= 0) & (y < len(rank))
            same[same] = rank[x[same]] == rank[y[same]]
            done[same] += step
        return done


class Wavelet:
    """A wavelet matrix: the least value of x or more in any interval, many questions at once."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.zeros, self.split = [], []
        for bit in reversed(range(self.bits)):
            one = (values >> bit & 1).astype(bool)
            zeros = np.zeros(len(values) + 1, np.int64)
            np.cumsum(~one, out=zeros[1:])
            self.zeros.append(zeros)
            self.split.append(int(zeros[-1]))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values in [lo, hi) are less than x."""
        found = np.where(x >> self.bits > 0, hi - lo, 0)
        inside = x >> self.bits == 0
        for level, (zeros, split) in enumerate(zip(self.zeros, self.split)):
            one = (x >> (self.bits - 1 - level) & 1).astype(bool)
            low, high = zeros[lo], zeros[hi]
            found += np.where(one & inside, high - low, 0)
            lo, hi = np.where(one, split + lo - low, low), np.where(one, split + hi - high, high)
        return found

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest value in [lo, hi), from 0."""
        found = np.zeros(len(lo), np.int64)
        for level, (zeros, split) in enumerate(zip(self.zeros, self.split)):
            low, high = zeros[lo], zeros[hi]
            one = k >= high - low
            k = np.where(one, k - (high - low), k)
            found |= one.astype(np.int64) << (self.bits - 1 - level)
            lo, hi = np.where(one, split + lo - low, low), np.where(one, split + hi - high, high)
        return found

    def successor(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The least value of x or more in [lo, hi), or -1."""
        k = self.below(lo, hi, x)
        found = np.full(len(lo), -1, np.int64)
        some = k < hi - lo
        found[some] = self.smallest(lo[some], hi[some], k[some])
        return found


def _least_block(min_words: int) -> int:
    """Any run with a period below this holds an aligned block of this length, with its copy: a level."""
    return max(0, ((min_words + 2) // 3).bit_length() - 1)


def _candidates(blocks: Blocks, least: int, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods among which every run has one."""
    if least >= len(blocks.ranks):
        return
    # The suffix array of the suffixes that begin with a repeated block.
    final = blocks.ranks[-1]
    order = np.empty(length, np.int64)
    order[final] = np.arange(length)
    kept = np.zeros(length, bool)
    kept[blocks.live[least]] = True
    before = np.zeros(length + 1, np.int64)
    np.cumsum(kept[order], out=before[1:])
    wavelet = Wavelet(order[kept[order]])
    for level in range(least, len(blocks.ranks)):
        size, live = 1 << level, blocks.live[level]
        at = live[live % size == 0]
        if not len(at):
            continue
        rank = blocks.ranks[level]
        sizes = np.bincount(rank[live], minlength=length)
        lo, hi = before[rank[at]], before[rank[at] + sizes[rank[at]]]

        def after(x, some, end):
            found = wavelet.successor(lo[some], hi[some], x)
            return np.where(found < end, found, -1)

        if level == least:
            some, x = np.arange(len(at)), at + 1
            for _ in range(size - 1):
                x = after(x, some, at[some] + size)
                some, x = some[x >= 0], x[x >= 0]
                yield at[some], x - at[some]
                x = x + 1
        every = np.arange(len(at))
        first = after(at + size, every, at + 2 * size)
        some = np.flatnonzero(first >= 0)
        second = np.full(len(at), -1, np.int64)
        second[some] = after(first[some] + 1, some, at[some] + 2 * size)
        some = np.flatnonzero(second >= 0)
        third = np.full(len(at), -1, np.int64)
        third[some] = after(second[some] + 1, some, at[some] + 2 * size)
        few = (first >= 0) & (third < 0)
        yield at[few], first[few] - at[few]
        two = few & (second >= 0)
        yield at[two], second[two] - at[two]
        many = third >= 0
        if many.any():
            block, copy, step = at[many], first[many], (second - first)[many]
            left = block - blocks.backward(block, block + step), copy - blocks.backward(copy, copy + step)
            right = block + blocks.forward(block, block + step), copy + blocks.forward(copy, copy + step)
            for near, far in (left, right):
                period = far - near
                fits = (left[0] != left[1]) & (period >= size) & (period < 2 * size)
                yield block[fits], period[fits]


def find_runs(values: np.ndarray, min_words: int = 24, min_repeats: int = 3) -> np.ndarray:
    """Rows of start, length and least period of every maximal run of at least `min_words` values and
    `min_repeats` periods in a sequence that ends in a value of its own, by start, then period."""
    blocks = Blocks(values)
    none = np.zeros((0, 3), np.int64)
    found = [none]
    for at, period in _candidates(blocks, _least_block(min_words), len(values)):
        start = at - blocks.backward(at, at + period)
        length = at + period + blocks.forward(at, at + period) - start
        long = (length >= min_words) & (length >= min_repeats * period)
        found.append(np.stack([start, length, period], 1)[long])
    rows = np.concatenate(found)
    if not len(rows):
        return none
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def _numbered(documents: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """One sequence of all documents, each with values of its own and a last one that occurs once, and their bounds."""
    parts, base, bounds = [], 0, [0]
    for words in documents:
        known: dict[bytes, int] = {}
        ids = [known.setdefault(w, len(known)) for w in words]
        ids.append(len(known))
        parts.append(np.array(ids, np.int64) + base)
        base += len(known) + 1
        bounds.append(bounds[-1] + len(ids))
    return np.concatenate(parts), np.array(bounds)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = 24, min_repeats: int = 3,
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """doc_id, runs and collapsed of every row.

    Words are divided by white space (space and U+0009 to U+000D) and numbered from 0. A run is a stretch of at
    least `min_words` words and `min_repeats` (3 or more) of its least period that cannot be extended; runs are
    structs of start, length and period, by start, then period. `collapsed` is the text without the words that
    a run holds after its first period, joined by single spaces. `rewrite` may change a row's words, in
    UTF-8, beforehand.

    NULL, empty and wordless texts have no runs and collapse to the empty text. Rows that share an id, or have
    none, are documents of their own. Narrow: a row's runs depend on the row alone, documents are worked off
    about a megabyte, or one longer document, at a time. Other columns are ignored; an empty table gives an
    empty result.
    """
    if min_repeats < 3 or min_words < 1:
        raise ValueError("at least 3 periods and 1 word are needed")
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                names = batch.column("doc_id").slice(part.first, len(part.bounds) - 1)
                documents = [part.data[a:b].tobytes().split() for a, b in zip(part.bounds[:-1].tolist(), part.bounds[1:].tolist())]
                if rewrite is not None:
                    documents = [rewrite(name, words) for name, words in zip(names.to_pylist(), documents)]
                values, bounds = _numbered(documents)
                rows = find_runs(values, min_words, min_repeats)
                owner = np.searchsorted(bounds, rows[:, 0], "right") - 1
                gone = np.zeros(len(values) + 1, np.int64)
                np.add.at(gone, rows[:, 0] + rows[:, 2], 1)
                np.add.at(gone, rows[:, 0] + rows[:, 1], -1)
                gone = np.cumsum(gone) > 0
                collapsed = [b" ".join(words) for words in documents]
                for k in np.unique(owner).tolist():
                    kept = ~gone[bounds[k] : bounds[k + 1] - 1]
                    collapsed[k] = b" ".join([w for w, keep in zip(documents[k], kept.tolist()) if keep])
                rows[:, 0] -= bounds[owner]
                runs = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], fields=list(RUN))
                ends = np.searchsorted(owner, np.arange(len(documents) + 1))
                yield pa.RecordBatch.from_arrays(
                    [names, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs), pa.array(collapsed, pa.binary()).cast(pa.string())],
                    names=["doc_id", "runs", "collapsed"])

    return plain.mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
