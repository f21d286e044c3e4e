"""Exact edit distance by bit vectors.

A column of the matrix of two sequences is kept as its vertical differences of +1 and -1, bits of two integers, and
one step moves 64 rows or more by a column (Myers). Pairs reach Python as Arrow columns:

* equal ends are stripped first, of a batch of pairs at once;
* short pairs are aligned many at once, a column of all of them per step, in blocks of 64 rows;
* a longer pair, or one of a length that few have, is aligned alone, with all rows in an integer;
* where an integer would hold too many rows, blocks visit a band around the diagonal, and all columns only if the
  distance turns out wider than the band.

The built-in `levenshtein` compares every pair of positions by itself: on sentences it takes several times as
long, and minutes on a pair of unsegmented texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType

#: Values up to which the variants of a row are no long ones.
SHORT = 1024
#: Blocks of the longer side up to which pairs are aligned many at once, how many, and how few are too few.
BATCHED, TOGETHER, ALONE = 4, 1024, 24
#: Rows of the matrix that one integer holds; more where there are few different values, each of which has one mask.
BLOCK, WIDE_BLOCK, FEW = 1 << 13, 1 << 16, 1 << 10


def _strip(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without their equal beginnings and ends."""
    for _ in range(2):
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        equal = int(differ[0]) if len(differ) else n
        a, b = a[equal:][::-1], b[equal:][::-1]
    return a, b


def _masks(block: np.ndarray) -> dict[int, int]:
    """For each value the bits of the places where a block has it."""
    order = np.argsort(block, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(block[order]) != 0))
    bits, out = np.zeros(len(block), bool), {}
    for places in np.split(order, starts[1:]):
        bits[places] = True
        out[int(block[places[0]])] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        bits[places] = False
    return out


def _whole(a: np.ndarray, b: np.ndarray) -> int:
    """The distance, with all rows in an integer."""
    if len(a) > SHORT:
        masks = _masks(a)
    else:
        masks, bit = {}, 1
        for v in a.tolist():
            masks[v] = masks.get(v, 0) | bit
            bit <<= 1
    full = plus = (1 << len(a)) - 1
    minus, get = 0, masks.get
    for v in b.tolist():
        same = get(v, 0)
        x = same | minus
        y = ((((same & plus) + plus) ^ plus) | same) & full
        up = (minus | full ^ (y | plus)) << 1 | 1
        minus, plus = full & up & x, full & ((plus & y) << 1 | full ^ full & (x | up))
    return len(b) + plus.bit_count() - minus.bit_count()


def _height(a: np.ndarray) -> int:
    return WIDE_BLOCK if len(np.unique(a)) <= FEW else BLOCK


def _banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """An upper bound on the distance, exact if it is at most `band`: cells further from the diagonal are passed by."""
    columns, height = b.tolist(), _height(a)
    # The last row of the blocks so far: from column `at` on.
    row, at = list(range(min(len(b), band) + 1)), 0
    for top in range(0, len(a), height):
        block = a[top : top + height]
        size, masks = len(block), _masks(block)
        full, last = (1 << size) - 1, 1 << (size - 1)
        first, end = max(0, top - band), min(len(b), top + size + band)
        plus, minus = full, 0
        value = row[first - at] + size
        below = [value]
        for c in range(first, end):
            k = c - at
            step = row[k + 1] - row[k] if k + 1 < len(row) else 1
            same = masks.get(columns[c], 0)
            x = same | minus
            if step < 0:
                same |= 1
            y = (((same & plus) + plus) ^ plus) | same
            up = minus | (full & ~(y | plus))
            down = plus & y
            if up & last:
                value += 1
            elif down & last:
                value -= 1
            below.append(value)
            up, down = up << 1, down << 1
            if step < 0:
                down |= 1
            elif step > 0:
                up |= 1
            plus = full & (down | ~(x | up))
            minus = full & up & x
        row, at = below, first
    return row[-1]


def distance(a: Sequence[int] | np.ndarray, b: Sequence[int] | np.ndarray) -> int:
    """Least number of inserted, deleted and replaced values between two sequences of numbers."""
    a, b = _strip(np.asarray(a, np.int64), np.asarray(b, np.int64))
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    if len(a) <= 2 * _height(a):  # a band would save nothing
        return _whole(a, b)
    band = len(a) - len(b) + max(64, len(a) // 8)
    found = _banded(a, b, band)
    return found if found <= band else _banded(a, b, len(a))


def distances(a: np.ndarray, others: list[np.ndarray]) -> list[int]:
    """`distance(a, b)` of one sequence and several that are alike.

    In order, each shares a beginning with the one before; its columns are taken over, so only what follows the
    first difference is aligned anew.
    """
    a = np.asarray(a, np.int64)
    if len(a) > _height(a) or not len(a):
        return [distance(a, b) for b in others]
    masks, full, last = _masks(a), (1 << len(a)) - 1, 1 << (len(a) - 1)
    sequences = [np.asarray(b, np.int64).tolist() for b in others]
    order = sorted(range(len(others)), key=sequences.__getitem__)
    shared = [_shared(sequences[x], sequences[y]) for x, y in zip(order, order[1:])]
    out, saved = [0] * len(others), [(0, full, 0, len(a))]
    for k, which in enumerate(order):
        while k and saved[-1][0] > shared[k - 1]:
            saved.pop()
        # Where later ones part from this one: their columns are kept.
        stops, least = set(), len(sequences[which])
        for n in shared[k:]:
            least = min(least, n)
            stops.add(least)
        at, plus, minus, value = saved[-1]
        for c in range(at, len(sequences[which])):
            if c in stops and c > saved[-1][0]:
                saved.append((c, plus, minus, value))
            same = masks.get(sequences[which][c], 0)
            x = same | minus
            y = (((same & plus) + plus) ^ plus) | same
            up = minus | (full & ~(y | plus))
            down = plus & y
            if up & last:
                value += 1
            elif down & last:
                value -= 1
            up = up << 1 | 1
            plus = full & (down << 1 | ~(x | up))
            minus = full & up & x
        end = len(sequences[which])
        if end in stops and end > saved[-1][0]:
            saved.append((end, plus, minus, value))
        out[which] = value
    return out


def _shared(a: list[int], b: list[int]) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


class Sequences(NamedTuple):
    """Sequences of numbers, one after the other."""

    values: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    def one(self, k: int) -> np.ndarray:
        return self.values[self.starts[k] : self.starts[k] + self.sizes[k]]

    def without(self, before: np.ndarray, after: np.ndarray) -> Sequences:
        """The sequences without some values at their beginnings and ends."""
        return Sequences(self.values, self.starts + before, self.sizes - before - after)

    def padded(self, which: np.ndarray, width: int) -> np.ndarray:
        """A row for each of some sequences, a number that none has behind its end."""
        place = np.arange(width)
        inside = place < self.sizes[which][:, None]
        out = np.full((len(which), width), np.iinfo(self.values.dtype).max, self.values.dtype)
        out[inside] = self.values[(self.starts[which][:, None] + place)[inside]]
        return out


def _places(block: np.ndarray):
    """For a value of each row, the bits of the places where the row's 64 have it."""
    rows = len(block)
    if block.dtype != np.uint8:
        block = np.ascontiguousarray(block)
        return lambda wanted: np.packbits(block[: len(wanted)] == wanted[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    # Few different values: a table of a mask for each, per row.
    width = 256
    table, base = np.zeros(rows * width, np.uint64), np.arange(rows) * width
    for k in range(64):
        table[base + block[:, k]] |= np.uint64(1 << k)
    return lambda wanted: table[base[: len(wanted)] + wanted]


def _columns(longer: np.ndarray, sizes: np.ndarray, other: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Distances of rows of two padded tables; rows in falling order of `columns`, sizes within the last 64 of the width."""
    pairs, blocks = len(longer), longer.shape[1] // 64
    one, top = np.uint64(1), np.uint64(63)
    plus = np.full((blocks, pairs), ~np.uint64(0))
    minus = np.zeros((blocks, pairs), np.uint64)
    places = [_places(longer[:, 64 * k : 64 * k + 64]) for k in range(blocks)]
    last = ((sizes - 1) % 64).astype(np.uint64)
    value, live = sizes.astype(np.int64), pairs
    for c in range(int(columns[0])):
        live = int(np.searchsorted(-columns, -c, "left"))
        wanted = other[:live, c]
        raise_, lower = np.ones(live, np.uint64), np.zeros(live, np.uint64)
        for k in range(blocks):
            p, m = plus[k, :live], minus[k, :live]
            same = places[k](wanted)
            x = same | m
            same |= lower
            y = (((same & p) + p) ^ p) | same
            up, down = m | ~(y | p), p & y
            if k == blocks - 1:
                value[:live] += ((up >> last[:live]) & one).astype(np.int64) - ((down >> last[:live]) & one).astype(np.int64)
            next_up, next_down = up >> top, down >> top
            up, down = (up << one) | raise_, (down << one) | lower
            plus[k, :live], minus[k, :live] = down | ~(x | up), up & x
            raise_, lower = next_up, next_down
    return value


def _equal_values(a: Sequences, b: Sequences, ends: bool) -> np.ndarray:
    """How many values each sequence and its counterpart share at their beginnings, or at their ends."""
    sizes = np.minimum(a.sizes, b.sizes)
    rows = np.flatnonzero(sizes)
    out, some = np.zeros(len(sizes), np.int64), sizes[rows]
    if not len(rows):
        return out
    first = np.cumsum(some) - some
    place = np.arange(int(some.sum())) - np.repeat(first, some)
    one, other = (np.repeat((s.starts + s.sizes - 1 if ends else s.starts)[rows], some) + (-place if ends else place) for s in (a, b))
    upto = np.where(a.values[one] == b.values[other], np.iinfo(np.int64).max, place)
    out[rows] = np.minimum(np.minimum.reduceat(upto, first), some)
    return out


def pair_distances(a: Sequences, b: Sequences) -> np.ndarray:
    """`distance` of each sequence of one table and its counterpart of the other."""
    for ends in (False, True):
        equal = _equal_values(a, b, ends)
        cut = (np.zeros_like(equal), equal) if ends else (equal, np.zeros_like(equal))
        a, b = a.without(*cut), b.without(*cut)
    out = np.maximum(a.sizes, b.sizes).astype(np.int64)  # right where one side is empty
    longest = np.maximum(a.sizes, b.sizes)
    blocks = np.where(np.minimum(a.sizes, b.sizes) > 0, -(-longest // 64), 0)
    blocks[blocks > BATCHED] = -1
    for kind in np.unique(blocks).tolist():
        rows = np.flatnonzero(blocks == kind)
        if kind < 0 or 0 < kind and len(rows) < ALONE:
            out[rows] = [distance(a.one(k), b.one(k)) for k in rows.tolist()]
        elif kind:
            rows = rows[np.argsort(-np.minimum(a.sizes[rows], b.sizes[rows]), kind="stable")]
            for at in range(0, len(rows), TOGETHER):
                some = rows[at : at + TOGETHER]
                first = a.sizes[some] >= b.sizes[some]
                sizes, columns = longest[some], np.minimum(a.sizes, b.sizes)[some]
                wide, narrow = 64 * kind, int(columns[0])
                longer, other = (np.empty((len(some), n), a.values.dtype) for n in (wide, narrow))
                for side, counterpart, of in ((a, b, first), (b, a, ~first)):
                    longer[of] = side.padded(some[of], wide)
                    other[of] = counterpart.padded(some[of], narrow)
                out[some] = _columns(longer, sizes, other, columns)
    return out


def _small(values: np.ndarray, largest: int) -> np.ndarray:
    """In the least type that holds the numbers and one more: eight of a byte are compared in the time of one."""
    return values.astype(np.uint8 if largest < 255 else np.uint16 if largest < 65535 else np.int32)


def _letters(*columns: pa.Array) -> list[Sequences]:
    """The code points of texts, numbered."""
    joined = ["".join(c.to_pylist()).encode("utf-32-le", "surrogatepass") for c in columns]
    codes = np.frombuffer(b"".join(joined), "<u4")
    number = np.zeros(int(codes.max(initial=0)) + 1, np.int32)
    number[codes] = 1
    values = _small((np.cumsum(number) - 1)[codes], int(number.sum()))
    out, at = [], 0
    for texts in columns:
        sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        out.append(Sequences(values[at : at + int(sizes.sum())], np.cumsum(sizes) - sizes, sizes))
        at += int(sizes.sum())
    return out


def _numbered_words(*columns: pa.Array) -> list[Sequences]:
    """The words of single-spaced texts as numbers that mean the same in all columns."""
    parts = [pc.split_pattern(c, " ") for c in columns]
    known = pa.concat_arrays([p.flatten() for p in parts]).dictionary_encode()
    numbers = _small(known.indices.to_numpy(zero_copy_only=False), len(known.dictionary))
    out, at = [], 0
    for texts, part in zip(columns, parts):
        sizes = pc.list_value_length(part).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        out.append(Sequences(numbers[at : at + int(sizes.sum())], starts, np.where(empty, 0, sizes)))
        at += int(sizes.sum())
    return out


def _both(a: pa.Array, b: pa.Array, sequences) -> pa.Array:
    """Distances of the rows that have both texts."""
    rows = pc.and_(pc.is_valid(a), pc.is_valid(b))
    out = np.zeros(len(rows), np.int64)
    known = rows.to_numpy(zero_copy_only=False)
    if known.any():
        out[known] = pair_distances(*sequences(a.filter(rows), b.filter(rows)))
    return pa.array(out, mask=~known)


@arrow_udf(LongType())
def _chars(a: pa.Array, b: pa.Array) -> pa.Array:
    return _both(a, b, _letters)


@arrow_udf(LongType())
def _words(a: pa.Array, b: pa.Array) -> pa.Array:
    return _both(a, b, _numbered_words)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _word_numbers(texts: list[str]) -> list[np.ndarray]:
    known: dict[str, int] = {}
    return [np.array([known.setdefault(w, len(known)) for w in text.split(" ")] if text else [], np.int64) for text in texts]


def _of_each(a: pa.Array, others: pa.Array, sequences, numbered) -> pa.Array:
    """Distances between each text and those of its array, which are as many in every row.

    Equal ones of a row are aligned once. Short rows are aligned together, and each text is taken apart once for all of its
    pairs; those of a long row are alike and take over each other's columns.
    """
    known = pc.and_(a.is_valid(), others.is_valid())
    a, others = a.filter(known), others.filter(known).flatten()
    rows, each = len(a), len(others) // max(len(a), 1)
    size = lambda texts: pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    out = np.zeros((rows, each), np.int64)
    long = np.maximum(size(a), size(others).reshape(rows, each).max(axis=1, initial=0)) > SHORT
    for k in np.flatnonzero(long).tolist():
        texts = others.slice(k * each, each).to_pylist()
        distinct = list(dict.fromkeys(texts))
        first, *rest = numbered([a[k].as_py(), *distinct])
        found = dict(zip(distinct, distances(first, rest) if len(rest) > 1 else [distance(first, y) for y in rest]))
        out[k] = [found[t] for t in texts]
    short = np.flatnonzero(~long)
    if len(short):
        columns = [others.take(pa.array(short * each + k)) for k in range(each)]
        first = np.tile(np.arange(each), (len(short), 1))
        for k in range(1, each):
            for before in range(k - 1, -1, -1):
                first[pc.equal(columns[k], columns[before]).to_numpy(zero_copy_only=False), k] = before
        own = [np.flatnonzero(first[:, k] == k) for k in range(each)]
        ones, pairs = sequences(a.take(pa.array(short)), pa.concat_arrays([c.take(pa.array(w)) for c, w in zip(columns, own)]))
        which = np.concatenate(own)
        part = np.zeros((len(short), each), np.int64)
        part[which, np.repeat(np.arange(each), [len(w) for w in own])] = pair_distances(Sequences(ones.values, ones.starts[which], ones.sizes[which]), pairs)
        out[short] = np.take_along_axis(part, first, axis=1)
    full = known.to_numpy(zero_copy_only=False)
    ends = pa.array(np.append(0, np.cumsum(np.where(full, each, 0))), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(out.ravel()), mask=pa.array(~full))


@arrow_udf(ArrayType(LongType()))
def _chars_of(a: pa.Array, others: pa.Array) -> pa.Array:
    return _of_each(a, others, _letters, lambda texts: [_code_points(t) for t in texts])


@arrow_udf(ArrayType(LongType()))
def _words_of(a: pa.Array, others: pa.Array) -> pa.Array:
    return _of_each(a, others, _numbered_words, _word_numbers)


def char_distances(a: Column, others: Column) -> Column:
    """`char_distance` of a text and each of an array of texts, of one length in all rows."""
    return _chars_of(a, others)


def word_distances(a: Column, others: Column) -> Column:
    """`word_distance` of a single-spaced text and each of an array of them, of one length in all rows."""
    return _words_of(a, others)


def edit_distance(a: Column, b: Column) -> Column:
    """Edits between two non-NULL strings in code points, in the JVM: for short strings and few of them."""
    return F.levenshtein(a, b).cast("bigint")


def char_distance(a: Column, b: Column) -> Column:
    """Edits between two non-NULL strings in code points."""
    return _chars(a, b)


def word_distance(a: Column, b: Column) -> Column:
    """Edits between the words of two single-spaced non-NULL strings."""
    return _words(a, b)
