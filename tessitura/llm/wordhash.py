"""Words of whole Arrow string columns as 64-bit hashes, a slice of documents at a time.

A word's hash is a polynomial over random byte values modulo 2^64, mixed at the end, so it is
a sum of table look-ups and needs no Python per word. Hashes stand for words wherever only
equality counts; two different words of one corpus share a hash with a chance of about
(distinct words)^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Separators [\x20\x09-\x0D] and [\x00-\x2F\x3A-\x60\x7B-\x7F]; the latter after folding A-Z.
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NOT_WORD = np.isin(np.arange(256), [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


@lru_cache(1)
def byte_values() -> np.ndarray:
    return np.random.default_rng(20240229).integers(0, 2**64, 256, np.uint64) | np.uint64(1)


class _Powers:
    """BASE^i, grown on demand."""

    def __init__(self) -> None:
        self.table = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            grown = np.full(max(n, 2 * len(self.table)), BASE)
            grown[0] = 1
            self.table = np.cumprod(grown)
        return self.table[:n]


POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Slice(NamedTuple):
    first: int  # the first document's row in the batch
    data: np.ndarray  # bytes of the slice's documents
    bounds: np.ndarray  # where each document begins; one more for the end


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Runs of whole documents of about `limit` bytes, or one longer document; NULL reads as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Slice(at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


class Words(NamedTuple):
    begin: np.ndarray  # first byte of each word in the slice
    end: np.ndarray
    doc: np.ndarray  # its document, counted within the slice
    hash: np.ndarray
    counts: np.ndarray  # words of each document


def words(part: Slice, separator: np.ndarray = WHITE, fold: bool = True) -> Words:
    """The maximal runs of bytes outside `separator`, which end at a document's bounds."""
    data = FOLD[part.data] if fold else part.data
    docs = len(part.bounds) - 1
    inside = ~separator[data]
    opens = inside.copy()
    cut = np.zeros(len(data) + 1, bool)
    cut[part.bounds] = True
    opens[1:] &= ~inside[:-1] | cut[1 : len(data)]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | cut[1 : len(data)]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    if not len(begin):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64), np.zeros(docs, np.int64))
    length = end - begin
    at = np.cumsum(length) - length
    letters = byte_values()[data[inside]]
    place = np.arange(len(letters)) - np.repeat(at, length)
    hashed = np.add.reduceat(letters * POWERS.upto(int(length.max()))[place], at)
    doc = np.searchsorted(part.bounds, begin, "right") - 1
    return Words(begin, end, doc, mix(hashed ^ length.astype(np.uint64)), np.bincount(doc, minlength=docs))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values, in order."""
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out = mix(out * BASE + hashes[k : len(hashes) - n + 1 + k])
    return out
